"""URL filtering with a blocked Bloom filter before an exact hash join, in DataFrame functions alone.

Rules name a host and the beginning of a path; a rule fits its host and all subdomains. The rules' keys (host + path)
are put into a blocked Bloom filter: a key's hash picks one block of 512 bits (eight words), and PROBES bits inside.
A URL has a key for each of its host's suffixes and each path length that rules have. Keys that the filter passes go on
to an exact hash join with the rules, which removes false positives; of the rules that fit, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 8
PROBES = 5
KEYS_PER_BLOCK = 48  # some ten bits a key
#: Up to so many rules (some 20 MB with their filter) both sides are broadcast; beyond, Spark shuffles the joins.
BROADCAST_RULES = 200_000
#: Pages of one host and path key are dealt to so many tasks when they get their verdicts.
SALTS = 16


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bits_of(key: Column) -> list[Column]:
    """Bit numbers 0 to 511 of a key, from a hash apart from the block's."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(511)).cast("int") for i in range(PROBES)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """block and words (array of WORDS longs) of the filter of keys (key). One row for each block in use."""
    bits = keys.select(block_of(F.col("key"), blocks).alias("block"), F.explode(F.array(*bits_of(F.col("key")))).alias("bit"))
    word = [F.bit_or(F.when(F.shiftright("bit", 6) == i, F.expr("shiftleft(1L, bit & 63)")).otherwise(F.lit(0).cast("long"))) for i in range(WORDS)]
    return bits.groupBy("block").agg(F.array(*word).alias("words"))


def may_contain(key: Column, words: Column) -> Column:
    ok = F.lit(True)
    for bit in bits_of(key):
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)))
        ok = ok & (F.element_at(words, F.shiftright(bit, 6) + 1).bitwiseAND(mask) != 0)
    return ok


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as a table."""
    rows = [F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("action", "host", "path"), strict=True))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    rules has action (allow or block), host and path; of equal host and path the least action counts. pages has page_id
    and url; other columns are not read. Null urls and urls without :// have an empty host and path. A URL that no rule
    fits gets default and a null rule. Repeated page_ids are judged by their own urls; equal rows stay. Without rules
    everything gets default.

    Distinct URL keys are looked up, so a host that a third of all pages share costs a few keys; verdicts go back to
    pages by host and the short path key they hang on, each verdict SALTS times, so that such a host is many tasks' work.
    """
    listed = rules.groupBy(F.concat("host", "path").alias("key"), "host", "path").agg(F.min("action").alias("action"))
    listed = listed.select("key", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action")
    shape = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("rule_path")).alias("lengths")).first()  # few lengths
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    if not shape["n"]:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = sorted(shape["lengths"])
    blocks = -(-shape["n"] // KEYS_PER_BLOCK)
    near = F.broadcast if shape["n"] <= BROADCAST_RULES else (lambda df: df)
    # what a URL's verdict hangs on: its host and its path up to the longest rule's
    head = F.left("path", F.lit(lengths[-1]))
    heads = parts.select("host", head.alias("head")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = heads.select("host", "head", F.explode(suffixes).alias("suffix"))
    starts = F.array_distinct(F.array(*(F.when(F.length("head") >= n, F.left("head", F.lit(n))) for n in lengths)))
    keys = keys.select("host", "head", "suffix", F.explode(starts).alias("start")).where("start is not null")
    keys = keys.select("host", "head", "suffix", "start", F.concat("suffix", "start").alias("key"), block_of(F.concat("suffix", "start"), blocks).alias("block"))
    passed = keys.join(near(bloom(listed, blocks)), "block").where(may_contain(F.col("key"), F.col("words")))
    exact = (F.col("suffix") == F.col("rule_host")) & (F.col("start") == F.col("rule_path"))
    fits = passed.join(near(listed), "key").where(exact)
    best = fits.groupBy("host", "head").agg(F.max_by(F.struct("key", "action"), F.struct(F.length("key"), "key")).alias("best"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
    out = parts.withColumns({"head": head, "salt": salt}).join(best, ["host", "head", "salt"], "left")
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
