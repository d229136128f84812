"""Queries over scans of files and structured text (SC1 to SC14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import Tables, query
from ..sources import files, json_text
from ..storage import shared_path
from .joins import PATH_SQL, url_path


@query("""select cast(o_orderkey as varchar) o_orderkey, cast(o_custkey as varchar) o_custkey, o_orderstatus, o_orderpriority from orders""")
def scan_delimited_strict(t: Tables) -> DataFrame:
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    path = shared_path(t.spark, "orders-csv")
    t("orders").select(columns).write.option("header", True).csv(path)
    return files.read_delimited(t.spark, path, columns)[0]


@query("""with e as (select event_id, event_type t, cast(json_extract(props, '$.k') as bigint) k from events)
select event_id, case when t in ('view', 'click') then cast(k || '.123456789012345678' as decimal(38,18)) end k, case t when 'error' then 'duplicate_key' when 'signup' then 'non_finite' when 'purchase' then 'malformed' end reason from e""")
def scan_json_props(t: Tables) -> DataFrame:
    """An exact decimal of each event's properties, or why they are refused."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    text = F.concat(F.lit('{"k": '), k, F.lit(".123456789012345678"))
    kind = lambda x: F.col("event_type") == x
    props = F.concat(text, F.when(kind("error"), ', "k": 1}').when(kind("signup"), ', "n": NaN}').when(kind("purchase"), "").otherwise("}"))
    rows = json_text.json_reasons(t("events").select("event_id", props.alias("props")), "props", "event_id", "props")
    return rows.select("event_id", F.when(F.col("reason").isNull(), files.json_field(F.col("props"), "$.k", "decimal(38,18)")).alias("k"), "reason")


@query("""with l as (select event_type, case when event_id % 10 = 0 then '{"id":' || event_id else '{"id":' || event_id || '}' end line from events)
select event_type, count(*) lines, sum(case when json_valid(line) then 0 else 1 end)::bigint invalid from l group by 1""")
def scan_jsonl_invalid_count(t: Tables) -> DataFrame:
    line = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 10 == 0, "").otherwise("}"))
    rows = t("events").select("event_type", F.try_parse_json(line).alias("parsed"))
    return rows.groupBy("event_type").agg(F.count("*").alias("lines"), F.count_if(F.col("parsed").isNull()).alias("invalid"))


@query(r"""select doc_id, i line_no, substr(l[i], 1, 40) part from (select doc_id, string_split(text, chr(10)) l from documents), range(2, 4) r(i) where i <= len(l)""")
def text_line_slice(t: Tables) -> DataFrame:
    found = files.lines(t("documents"), "text", "doc_id").where("line_no between 2 and 3")
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.left("line", F.lit(40)).alias("part"))


@query(f"""with p as (select page_id, {PATH_SQL} || ['.json', '.H5', '.npz', '.pkl', '.txt', '.bin', '.npz', '.csv', '.PICKLE', '.log', '.tsv'][length(html) % 11 + 1] path, length(html) % 11 k, length(html) % 3 d from pages),
o as (select page_id, k, path, case when k in (1, 3) then 'hdf5' when k = 2 and not contains(path, '/.') then 'npz' else map {{'.json': 'json', '.csv': 'csv', '.tsv': 'tsv', '.log': 'text', '.txt': 'text'}}[regexp_extract(path, '[^/]([.][^./]*)$', 1)] end observed, case d when 0 then 'csv' when 1 then 'text' end declared from p)
select page_id, observed, case when observed is null then case when k = 8 and not contains(path, '/.') then 'unsafe' else 'unsupported' end when declared <> observed then 'mismatch' end problem from o""")
def classify_sources(t: Tables) -> DataFrame:
    """Pages as files of eleven names: two begin as HDF5 (one named as a pickle), one of two NPZ as a ZIP."""
    n = F.length("html")
    suffixes = (".json", ".H5", ".npz", ".pkl", ".txt", ".bin", ".npz", ".csv", ".PICKLE", ".log", ".tsv")
    path = F.concat(url_path(F.col("url")), F.element_at(F.array(*map(F.lit, suffixes)), (n % 11 + 1).cast("int")))
    magic = F.when((n % 11).isin(1, 3), F.unhex(F.lit(files.HDF5_MAGIC))).when(n % 11 == 2, F.unhex(F.lit(files.ZIP_MAGIC[0]))).otherwise(F.unhex(F.lit("")))
    head = F.concat(magic, F.col("html").cast("binary"))
    declared = F.when(n % 3 == 0, "csv").when(n % 3 == 1, "text")
    return t("pages").select("page_id", files.classified(path, head, declared).alias("c")).select("page_id", "c.*")


@query()
def file_inventory(t: Tables) -> DataFrame:
    return files.inventory(t.spark, t.sf_dir).where(F.col("path").endswith(".parquet"))


PATTERNS = ["http://*.example.com/en/*", "https://m.*.example.net/d?/*", "https://*.example.[a-n]*/fr/*"]


@query("""select page_id, url from pages where regexp_matches(url, '^http://[^/]*\\.example\\.com/en/[^/]*$') or regexp_matches(url, '^https://m\\.[^/]*\\.example\\.net/d[^/]/[^/]*$')
or regexp_matches(url, '^https://[^/]*\\.example\\.[a-n][^/]*/fr/[^/]*$')""".replace("\\\\", "\\"))
def match_path_patterns(t: Tables) -> DataFrame:
    patterns = [files.glob_regex(p) for p in PATTERNS]
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("url").rlike(p)
    return t("pages").where(hit).select("page_id", "url")


@query("""select distinct u.conv_id, u.turn from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'""")
def discover_pairs(t: Tables) -> DataFrame:
    c = t("conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.where("role = 'user'").select("conv_id", "turn").join(answers, ["conv_id", "turn"], "left_semi").distinct()


@query("""select doc_id, lang, source from documents where lang is not null and source is not null""")
def frontmatter_map(t: Tables) -> DataFrame:
    text = F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\nsource: "), F.col("source"), F.lit("\n---\n"), F.left("text", F.lit(50)))
    m = t("documents").where("lang is not null and source is not null and text is not null").select("doc_id", files.front_matter(text).alias("m"))
    return m.select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"))


@query("""select n_nationkey, 0::bigint row_no, 0::bigint col_no, 'key' cell from nation union all select n_nationkey, 0, 1, 'a|b' from nation
union all select n_nationkey, 1, 0, cast(n_nationkey as varchar) from nation union all select n_nationkey, 1, 1, n_name from nation""")
def markdown_table_cells(t: Tables) -> DataFrame:
    text = F.concat(F.lit("| key | a\\|b |\n| --- | --- |\n| "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.col("n_name"), F.lit(" |"))
    found = files.markdown_cells(t("nation").select("n_nationkey", text.alias("text")), "text", "n_nationkey")
    return found.select("n_nationkey", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), "cell")


@query("""select o_custkey, max(o_orderkey) o_orderkey from orders o where (o_custkey, o_orderdate) in (select (o_custkey, max(o_orderdate)) from orders where o_orderstatus in ('F', 'O') group by o_custkey) and o_orderstatus in ('F', 'O') group by o_custkey""")
def select_newest_slot(t: Tables) -> DataFrame:
    slots = t("orders").where(F.col("o_orderstatus").isin("F", "O"))
    return slots.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("""select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) k from events where event_type like '%c%') where k = 1""")
def latest_match(t: Tables) -> DataFrame:
    return t("events").where(F.col("event_type").like("%c%")).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(r"""select doc_id, regexp_replace(right(text, 64), '[\x00-\x1F\x7F]', ' ', 'g') tail, length(text) > 64 cut from documents""")
def text_tail(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", files.tail(F.col("text"), 64).alias("s")).select("doc_id", "s.tail", "s.cut")


@query()
def scan_npz_members(t: Tables) -> DataFrame:
    """Embeddings of a label as the members of one NPZ file each, read back."""

    def pack(pdf):
        import io

        import numpy as np
        import pandas as pd

        buffer = io.BytesIO()
        pdf = pdf.sort_values("vec_id")
        np.savez(buffer, ids=pdf["vec_id"].to_numpy(), first=np.array([v[0] for v in pdf["embedding"]]))
        return pd.DataFrame({"path": [f"label-{pdf['part'].iloc[0]}.npz"], "content": [buffer.getvalue()]})

    parts = t("embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 500).alias("part"))
    found = files.npz_members(parts.groupBy("part").applyInPandas(pack, "path string, content binary"))
    return found.select("file", "member", "dtype", "shape", F.size("values").alias("n"))
