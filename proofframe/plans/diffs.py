"""Queries over dataset comparison and fingerprints (DC1 to DC16, FP1 to FP15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import render
from ..operators import compare, tables
from ..operators.fixpoint import ancestors, reach
from ..operators.generations import Generations, refreshed
from ..operators.members import member_differences
from ..operators.support import currentness, resolved
from ..registry import Tables, query
from ..sources import delimited, files, json_text
from ..storage import shared_path, stored
from .joins import PATH_SQL, PERTURBED, url_path


@query("""select page_id, case when regexp_matches(url, '[.](csv|tsv)$') then 'table' when regexp_matches(url, '[.]json$') then 'json' when regexp_matches(url, '/$') then 'directory' when contains(url, '?') then 'bytes' else 'text' end profile from pages""")
def diff_profile(t: Tables) -> DataFrame:
    u = F.col("url")
    profile = F.when(u.rlike("[.](csv|tsv)$"), "table").when(u.rlike("[.]json$"), "json").when(u.endswith("/"), "directory").when(u.contains("?"), "bytes").otherwise("text")
    return t("pages").select("page_id", profile.alias("profile"))


OLD_ROWS = """(select o_orderkey, o_orderstatus, cast(o_custkey as varchar) a, cast(round(o_totalprice * 100) as bigint) || '.5' b, case when o_orderkey % 50 = 0 then 'nan' else o_orderstatus end c from orders)"""


@query(f"""with a as (select row_number() over (order by o_orderkey) p, o_orderkey k, a, b, c from {OLD_ROWS} s),
b as (select row_number() over (order by o_orderkey) p, o_orderkey k, case when k % 101 = 0 then a || '.0' else a end a, case when k % 97 = 0 then '1' || b when k % 103 = 0 then b || '0' else b end b, case when k % 50 = 0 then 'NaN' when k % 89 = 0 then 'O,X' else c end c from (select *, o_orderkey k from {OLD_ROWS} s where o_orderstatus <> 'P' or o_orderkey < (select 0.9 * max(o_orderkey) from orders)) s),
j as (select coalesce(a.p, b.p) "position", a.k, b.k bk, a.a, a.b, a.c, b.a xa, b.b xb, b.c xc from a full join b on a.p = b.p),
d as (select "position", null "column", 'availability' what, case when k is not null then 'row' end "expected", case when bk is not null then 'row' end found from j where k is null or bk is null
union all select "position", null, 'width', '4', '5' from j where contains(xc, ',') and k is not null
union all select "position", 1, 'value', cast(k as varchar), cast(bk as varchar) from j where k <> bk and not contains(xc, ',')
union all select "position", 2, case when contains(xa, '.') then 'type' else 'value' end, a, xa from j where a <> xa and not contains(xc, ',')
union all select "position", 3, 'value', b, xb from j where cast(b as double) <> cast(xb as double) and not contains(xc, ',')
union all select "position", 4, case when (lower(c) = 'nan') <> (lower(xc) = 'nan') then 'type' else 'value' end, c, xc from j where lower(c) <> lower(xc) and not contains(xc, ','))
select "position", cast("column" as integer) "column", what, "expected", found from d""")
def table_diff(t: Tables) -> DataFrame:
    """Orders written as delimited files, against a copy with other types, values, widths and spellings, and rows gone
    near the end, by position."""
    key = F.col("o_orderkey")
    price = F.concat(F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), F.lit(".5"))
    old = t("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("a"), price.alias("b"), F.when(key % 50 == 0, "nan").otherwise(F.col("o_orderstatus")).alias("c"), "o_orderstatus")
    last = t("orders").agg((F.max("o_orderkey") * 0.9).alias("last"))
    new = old.join(F.broadcast(last)).where("o_orderstatus <> 'P' or o_orderkey < last").select(
        "o_orderkey", F.when(key % 101 == 0, F.concat("a", F.lit(".0"))).otherwise(F.col("a")).alias("a"),
        F.when(key % 97 == 0, F.concat(F.lit("1"), "b")).when(key % 103 == 0, F.concat("b", F.lit("0"))).otherwise(F.col("b")).alias("b"),
        F.when(key % 50 == 0, "NaN").when(key % 89 == 0, "O,X").otherwise(F.col("c")).alias("c"),
    )
    sides = []
    for df in (old, new):
        path = shared_path(t.spark, "orders-text")
        n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
        line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "a", "b", "c")
        df.repartitionByRange(n, "o_orderkey").sortWithinPartitions("o_orderkey").select(line).write.text(path)
        sides.append(delimited.positioned(t.spark, path))
    return tables.table_differences(*sides)


def edited(docs: DataFrame) -> DataFrame:
    """Copies of documents, with every "the" written large in every third one."""
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "the", "THE")).otherwise(F.col("text")).alias("text"))


@query("""with a as (select doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
d as (select doc_id, i, x, case when doc_id % 3 = 0 then replace(x, 'the', 'THE') else x end y from a where doc_id % 3 = 0 and contains(x, 'the'))
select doc_id, min(i)::bigint line_no, left(arg_min(x, i), 256) "expected", left(arg_min(y, i), 256) found from d group by 1""")
def text_diff(t: Tables) -> DataFrame:
    """The first line of each document that differs from its edited copy."""
    docs = t("documents")
    keys = ["doc_id", "line_no"]
    both = compare.full(files.lines(docs, "text", "doc_id"), files.lines(edited(docs), "text", "doc_id"), keys)
    d = both.where(~F.col("a.line").eqNullSafe(F.col("b.line"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.left("a.line", F.lit(256)).alias("x"), F.left("b.line", F.lit(256)).alias("y"))
    return d.groupBy("doc_id").agg(F.min("line_no").alias("line_no"), F.min_by("x", "line_no").alias("expected"), F.min_by("y", "line_no").alias("found"))


@query("""with e as (select event_id, event_type t, cast(json_extract(props, '$.k') as bigint) k from events)
select event_id, '$["k"]' path, k::varchar "expected", '"' || k || '"' found from e where t = 'error' union all select event_id, '$["k"]', k::varchar, k || '.0' from e where t = 'purchase'
union all select event_id, '$ keys', '["deep", "k", "l"]', '["deep", "k", "l", "m"]' from e where t = 'signup' and k % 2 = 0 union all select event_id, '$', '{"k": ' || k || ', "l": [1, 0.0], "deep": {"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}}}', 'duplicate_key' from e where t = 'signup' and k % 2 = 1
union all select event_id, '$["l"] length', '2', '3' from e where t = 'view' and k % 2 = 0 union all select event_id, '$["l"][1]', '0.0', '-0.0' from e where t = 'view' and k % 2 = 1
union all select event_id, '$["deep"]["a"]["b"]["c"]["d"]["e"]["f"]["g"]', '1', '2' from e where t = 'click' and k % 2 = 1""")
def json_diff(t: Tables) -> DataFrame:
    """Properties of events against copies that differ in one thing each, and some in the order of keys alone."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    e = t("events").select("event_id", "event_type", k.alias("k"), (k % 2 == 1).alias("odd"))
    kind = lambda x: F.col("event_type") == x

    def text(k: Column, array: Column, g: Column, more: Column) -> Column:
        deep = F.concat(F.lit('"deep": {"a": {"b": {"c": {"d": {"e": {"f": {"g": '), g, F.lit("}}}}}}}"))
        return F.concat(F.lit('{"k": '), k, F.lit(', "l": '), array, F.lit(", "), deep, more, F.lit("}"))

    as_text, none = F.col("k").cast("string"), F.lit("")
    other_k = F.when(kind("error"), F.concat(F.lit('"'), as_text, F.lit('"'))).when(kind("purchase"), F.concat(as_text, F.lit(".0"))).otherwise(as_text)
    other_l = F.when(kind("view") & ~F.col("odd"), "[1, 0.0, null]").when(kind("view"), "[1, -0.0]").otherwise("[1, 0.0]")
    more = F.when(kind("signup"), F.when(F.col("odd"), ', "k": 1').otherwise(', "m": null')).otherwise("")
    turned = F.concat(F.lit('{"l": [1, 0.0], "k": '), as_text, F.lit(', "deep": {"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}}}'))
    found = F.when(kind("click") & ~F.col("odd"), turned).otherwise(text(other_k, other_l, F.when(kind("click"), "2").otherwise("1"), more))
    pairs = e.select("event_id", text(as_text, F.lit("[1, 0.0]"), F.lit("1"), none).alias("expected"), found.alias("found"))
    return json_text.json_differences(pairs, "expected", "found", "event_id")


@query("""select doc_id, strlen(text)::bigint a_bytes, strlen(text)::bigint b_bytes, strlen(left(text, instr(text, 'the') - 1))::bigint first from documents where doc_id % 3 = 0 and contains(text, 'the')""")
def bytes_diff(t: Tables) -> DataFrame:
    """Sizes of documents that differ from their edited copies, and the first byte that does."""
    docs = t("documents")
    both = compare.full(docs.select("doc_id", "text"), edited(docs), ["doc_id"]).select("doc_id", compare.bytes_diff(F.col("a.text"), F.col("b.text")).alias("d"))
    return both.where("not d.equal").select("doc_id", "d.a_bytes", "d.b_bytes", "d.first")


@query("""select vec_id, true shape_equal, case when vec_id % 3 = 0 then 4 else -1 end "first" from embeddings""")
def array_diff(t: Tables) -> DataFrame:
    a = F.col("embedding").cast("array<double>")
    b = F.when(F.col("vec_id") % 3 == 0, F.transform(a, lambda x, i: F.when(i == 4, -x).otherwise(x))).otherwise(a)
    d = t("embeddings").select("vec_id", compare.array_diff(a, b).alias("d"))
    return d.select("vec_id", "d.shape_equal", "d.first")


@query("""with e as (select vec_id // 100 container, vec_id member, embedding v from embeddings), o as (select container, member, case when member % 7 = 0 then list_reverse(v) else v end v from e where member % 13 <> 0)
select e.container, case when o.member is null then 'deleted' when len(list_filter(range(1, len(e.v) + 1), lambda i: e.v[i] is distinct from o.v[i] or (e.v[i] = 0 and signbit(e.v[i]) <> signbit(o.v[i])))) > 0 then 'changed' else 'same' end change, count(*) n from e left join o using (container, member) group by 1, 2""")
def container_diff(t: Tables) -> DataFrame:
    """Named arrays of two sides, by container and member."""
    e = t("embeddings").select(F.floor(F.col("vec_id") / 100).alias("container"), F.col("vec_id").alias("member"), F.col("embedding").cast("array<double>").alias("v"))
    other = e.where("member % 13 <> 0").withColumn("v", F.when(F.col("member") % 7 == 0, F.reverse("v")).otherwise(F.col("v")))
    both = compare.full(e, other, ["container", "member"])
    d = compare.array_diff(F.col("a.v"), F.col("b.v"))
    change = F.when(F.col("b").isNull(), "deleted").when(F.col("a").isNull(), "added").when(d["first"] >= 0, "changed").otherwise("same")
    return both.groupBy("container", change.alias("change")).agg(F.count("*").alias("n"))


@query(f"""with p as (select page_id, {PATH_SQL} path, html, length(html) n from pages)
select page_id, path || case n % 4 when 0 then '.txt' when 1 then '.json' when 2 then '.csv' else '.bin' end "name", case n % 4 when 0 then 'text' when 1 then 'json' when 2 then 'table' else 'bytes' end profile,
case when n % 17 = 0 then 'members' when n % 4 = 0 then 'line 2' when n % 4 = 1 then '$["n"]' when n % 4 = 2 then 'row 2 column 2 type' else 'byte ' || (strlen(html) - 1) end "location",
case when n % 17 = 0 then 'member' when n % 4 = 0 then 'end' when n % 4 < 3 then n::varchar else '3e' end "expected", case when n % 17 = 0 then null when n % 4 = 0 then 'End' when n % 4 = 1 then '"' || n || '"' when n % 4 = 2 then n || '.0' else '3c' end found
from p where n % 6 = 0 or n % 5 = 0 or n % 17 = 0""")
def directory_diff(t: Tables) -> DataFrame:
    """Pages as members of four kinds, against a folder where some differ and some are gone."""
    n = F.length("html")
    p = t("pages").select("page_id", url_path(F.col("url")).alias("path"), "html", n.alias("n"), (n % 4).alias("kind"), ((n % 6 == 0) | (n % 5 == 0)).alias("edited"))
    k = F.col("kind")
    name = F.concat("path", F.when(k == 0, ".txt").when(k == 1, ".json").when(k == 2, ".csv").otherwise(".bin"))
    size = F.col("n").cast("string")

    def content(last: str, number: str, byte: str) -> Column:
        quoted = F.format_string(number, size)
        return F.when(k == 0, F.concat(F.regexp_replace("html", "\n", " "), F.lit("\n" + last))).when(k == 1, F.concat(F.lit('{"x": [1, 2], "n": '), quoted, F.lit("}"))).when(k == 2, F.concat(F.lit("id,n\n"), F.col("page_id").cast("string"), F.lit(","), F.replace(quoted, F.lit('"'), F.lit("")), F.lit("\n"))).otherwise(F.concat(F.substring("html", F.lit(1), F.length("html") - 1), F.lit(byte)))

    changed = F.when(k == 2, content("End", "%s.0", "<")).otherwise(content("End", '"%s"', "<"))
    old = p.select("page_id", name.alias("name"), content("end", "%s", ">").alias("content"))
    new = p.where("n % 17 <> 0").select("page_id", name.alias("name"), F.when(F.col("edited"), changed).otherwise(content("end", "%s", ">")).alias("content"))
    return member_differences(old, new, "page_id")


TOLERANT = f"""with j as (select a.o_orderkey, a.o_orderstatus, case when b.o_orderkey is null then 'missing' when a.o_totalprice = b.o_totalprice then 'exact' when abs(cast(a.o_totalprice as decimal(30,10)) - cast(b.o_totalprice as decimal(30,10))) <= 0.01 then 'within' else 'changed' end outcome from orders a left join {PERTURBED} b using (o_orderkey))"""


@query(f"""{TOLERANT} select s.o_orderstatus, c.outcome, count(j.o_orderkey) n from (select unnest(['F', 'O', 'P']) o_orderstatus) s cross join (select unnest(['exact', 'within', 'changed', 'missing']) outcome) c left join j on j.o_orderstatus = s.o_orderstatus and j.outcome = c.outcome group by 1, 2""")
def tolerance_compare(t: Tables) -> DataFrame:
    """How many prices are exact, within tolerance, changed or missing, for each order status, zeroes included."""
    found = compare.tolerance_outcome(t("orders"), compare.perturbed(t("orders")), ["o_orderkey"], "o_totalprice", "0.01")
    counts = found.groupBy(F.col("a.o_orderstatus").alias("o_orderstatus"), "outcome").agg(F.count("*").alias("n"))
    closed = t("region").limit(1).select(F.explode(F.array(*map(F.lit, "FOP"))).alias("o_orderstatus"))
    closed = closed.select("o_orderstatus", F.explode(F.array(*map(F.lit, ("exact", "within", "changed", "missing")))).alias("outcome"))
    return closed.join(counts, ["o_orderstatus", "outcome"], "left").select("o_orderstatus", "outcome", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""select (select count(*) from orders) = (select count(*) from {PERTURBED}) matches_equal, (select max(o_orderkey) from orders) = (select max(o_orderkey) from {PERTURBED}) last_equal, true columns_equal""")
def selection_shape_equal(t: Tables) -> DataFrame:
    a, b = t("orders"), compare.perturbed(t("orders"))
    x = a.agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    y = b.agg(F.count("*").alias("m"), F.max("o_orderkey").alias("end"))
    return x.join(F.broadcast(y)).select((F.col("n") == F.col("m")).alias("matches_equal"), (F.col("last") == F.col("end")).alias("last_equal"), F.lit(sorted(a.columns) == sorted(b.columns)).alias("columns_equal"))


@query("""select doc_id, case when n is null then 'not_numeric' else 'unscoped' end reason from (select doc_id, try_cast(regexp_extract(source, '[0-9]+$') as integer) n, doc_id in (select doc_id from labels) scoped from documents) where n is null or not scoped""")
def invalid_tolerances(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", F.regexp_extract("source", "[0-9]+$", 0).try_cast("int").alias("n"))
    bad = d.where("n is null").select("doc_id", F.lit("not_numeric").alias("reason"))
    return bad.unionByName(d.where("n is not null").join(t("labels"), "doc_id", "left_anti").select("doc_id", F.lit("unscoped").alias("reason")))


@query(f"""{TOLERANT} select o_orderkey, case outcome when 'exact' then 'matched' when 'within' then 'matched_by_evidence' else outcome end verdict from j""")
def compare_escalate(t: Tables) -> DataFrame:
    found = compare.tolerance_outcome(t("orders"), compare.perturbed(t("orders")), ["o_orderkey"], "o_totalprice", "0.01")
    o = F.col("outcome")
    return found.select("o_orderkey", F.when(o == "exact", "matched").when(o == "within", "matched_by_evidence").otherwise(o).alias("verdict"))


@query(f"""select case when a.o_orderkey % 103 = 0 then 'unavailable' when b.o_orderkey is null then 'missing_output' when a.o_totalprice = b.o_totalprice then 'matched' else 'changed' end outcome, count(*) n from orders a left join {PERTURBED} b using (o_orderkey) group by 1""")
def artifact_outcomes(t: Tables) -> DataFrame:
    both = compare.full(t("orders"), compare.perturbed(t("orders")), ["o_orderkey"])
    a, b = F.col("a.o_totalprice"), F.col("b.o_totalprice")
    o = F.when(F.col("o_orderkey") % 103 == 0, "unavailable").when(b.isNull(), "missing_output").when(a.isNull(), "extra").when(compare.same_double(a, b), "matched").otherwise("changed")
    return both.groupBy(o.alias("outcome")).agg(F.count("*").alias("n"))


@query("""select s_suppkey, s_suppkey % 9 <> 0 ok from supplier""")
def presentation_check(t: Tables) -> DataFrame:
    text = render.fixed(F.col("s_acctbal"), 2)
    shown = F.when(F.col("s_suppkey") % 9 == 0, F.concat(text, F.lit("1"))).when(F.col("s_suppkey") % 2 == 0, F.concat(text, F.lit(" ± "), text)).otherwise(F.concat(text, F.lit(" +/- "), text))
    return t("supplier").select("s_suppkey", F.array_contains(render.forms([text, text], "plus_minus"), shown).alias("ok"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents),
k as (select doc_id, line_no, unnest(regexp_extract_all(' ' || line, '\s([+-]?[0-9][^\s]*)', 1)) token from l where not contains(line, '|'))
select doc_id, line_no, token from k where not regexp_matches(token, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') and not regexp_matches(token, '(?i)^[0-9]+\s*PH(\b|$)') and not regexp_matches(token, '[A-Za-z_][A-Za-z0-9_.-]*\s*=') and not regexp_matches(token, '^[0-9a-fA-F]{12,}$')
and not regexp_matches(token, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$') and token not in (select event_id::varchar from events)""")
def unreferenced_numbers(t: Tables) -> DataFrame:
    """Numbers in prose outside table lines that no event value refers to."""
    lines = files.lines(t("documents"), "text", "doc_id").where(~F.col("line").contains("|"))
    tokens = lines.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"(?<!\S)[+-]?[0-9][^\s]*"), F.lit(0))).alias("token")).where(render.numeric_expression(F.col("token")))
    known = t("events").select(F.col("event_id").cast("string").alias("token"))
    return tokens.join(known, "token", "left_anti")


@query("""select doc_id, sha256(text) digest, strlen(text)::bigint bytes from documents""")
def file_fingerprint(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def group_digest(*columns: str) -> Column:
    """A digest of a group's rows, in order; a group's digests, not its contents, come together."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", *columns))), "\n"), 256)


@query("""select conv_id, sha256(string_agg(l, chr(10) order by l)) digest from (select conv_id, turn || ':' || sha256(text) l from conversations) group by 1""")
def group_fingerprint(t: Tables) -> DataFrame:
    c = t("conversations").select("conv_id", F.col("turn").cast("string").alias("turn"), F.sha2("text", 256).alias("h"))
    return c.groupBy("conv_id").agg(group_digest("turn", "h").alias("digest"))


@query("""select conv_id, sha256(string_agg(l, chr(10) order by l)) digest from (select conv_id, turn || ':' || sha256(text) l from conversations where role like 'us%') group by 1""")
def subset_fingerprint(t: Tables) -> DataFrame:
    c = t("conversations").where(F.col("role").rlike(files.glob_regex("us*"))).select("conv_id", F.col("turn").cast("string").alias("turn"), F.sha2("text", 256).alias("h"))
    return c.groupBy("conv_id").agg(group_digest("turn", "h").alias("digest"))


@query("""select conv_id, sha256(string_agg(n || ':' || h, '' order by turn, h)) digest from (select conv_id, turn, sha256(text) h, strlen(text) n from conversations) group by 1""")
def tree_hash(t: Tables) -> DataFrame:
    """A hash of hashes: each member's length and digest in order, so texts are hashed where they are and don't meet."""
    part = F.struct("turn", F.sha2("text", 256).alias("h"), F.octet_length("text").cast("string").alias("n"))
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select("conv_id", F.sha2(F.array_join(F.transform("parts", lambda p: F.concat(p["n"], F.lit(":"), p["h"])), ""), 256).alias("digest"))


def earlier_documents(t: Tables) -> DataFrame:
    """Documents as they were before: some had other texts, some weren't there yet, some have gone since."""
    d = t("documents").select("doc_id", "n_chars", F.lit(1).alias("modified"), "text")
    then = d.where("n_chars % 7 <> 0").withColumn("text", F.replace("text", F.lit(" and "), F.lit(" & ")))
    gone = d.where("n_chars % 11 = 0").withColumns({"doc_id": -1 - F.col("doc_id"), "text": F.concat("text", F.lit(" gone"))})
    return then.unionByName(gone).select("doc_id", "modified", "text")


@query("""select doc_id, sha256(text) digest, n_chars % 7 <> 0 and not contains(text, ' and ') and lang <> 'de' reused from documents""")
def incremental_hash(t: Tables) -> DataFrame:
    """Digests of the documents, after a run over the earlier ones: what has its size and time of change as before keeps
    its stored digest, the rest alone is hashed."""
    sized = lambda df: df.select("doc_id", F.octet_length("text").alias("size"), "modified", "text")
    hashed = lambda df: df.select("doc_id", "size", "modified", F.sha2("text", 256).alias("digest"))
    cache = Generations(t.spark, shared_path(t.spark, "digests"), "doc_id long, size int, modified int, digest string, reused boolean")
    refreshed(cache, sized(earlier_documents(t)), ["doc_id"], ["size", "modified"], hashed, ["digest"])
    touched = F.when(F.col("lang") == "de", 2).otherwise(1)
    now = sized(t("documents").select("doc_id", touched.alias("modified"), "text"))
    return refreshed(cache, now, ["doc_id"], ["size", "modified"], hashed, ["digest"])[0].select("doc_id", "digest", "reused")


MEASURED = """select sha256(text) s, l.loc, case l.loc when '$.words' then length(text) - length(replace(text, ' ', '')) else length(text) - length(replace(text, chr(10), '')) end v from"""


@query(f"""with l as (select unnest(['$.words', '$.lines']) loc),
a as (select distinct * from ({MEASURED} (select replace(text, ' and ', ' & ') as text from documents where n_chars % 7 <> 0 union all select text || ' gone' from documents where n_chars % 11 = 0), l)),
b as (select distinct * from ({MEASURED} documents, l))
select coalesce(a.s, b.s) source_identity, coalesce(a.loc, b.loc) locator, coalesce(a.v, b.v) "value", case when a.s is null then 'computed' when b.s is null then 'evicted' else 'hit' end outcome from a full join b on a.s = b.s and a.loc = b.loc""")
def cache_evict(t: Tables) -> DataFrame:
    """Measures of texts, kept by (source, profile, locator, version): found, computed anew, or gone with their texts."""
    key = ["source_identity", "profile", "locator", "version"]

    def wanted(docs: DataFrame) -> DataFrame:
        texts = docs.select(F.sha2("text", 256).alias("source_identity"), F.lit("text").alias("profile"), F.lit("1").alias("version"), "text").dropDuplicates(["source_identity"])
        return texts.withColumn("locator", F.explode(F.array(F.lit("$.words"), F.lit("$.lines"))))

    def measured(rows: DataFrame) -> DataFrame:
        mark = F.when(F.col("locator") == "$.words", " ").otherwise("\n")
        return rows.select(*key, (F.length("text") - F.length(F.replace("text", mark, F.lit("")))).cast("long").alias("value"))

    cache = Generations(t.spark, shared_path(t.spark, "selections"), "source_identity string, profile string, locator string, version string, value long, reused boolean")
    before, _ = refreshed(cache, wanted(earlier_documents(t)), key, [], measured, ["value"])
    now, _ = refreshed(cache, wanted(t("documents")), key, [], measured, ["value"])
    gone = before.join(now, key, "left_anti").select("source_identity", "locator", "value", F.lit("evicted").alias("outcome"))
    outcome = F.when(F.col("reused"), "hit").otherwise("computed")
    return now.select("source_identity", "locator", "value", outcome.alias("outcome")).unionByName(gone)


@query("""select o_custkey, sha256(string_agg(l, chr(10) order by l)) digest from (select o_custkey, o_orderkey || ':' || o_orderstatus l from orders) group by 1""")
def dependency_digest(t: Tables) -> DataFrame:
    return t("orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("k"), "o_orderstatus").groupBy("o_custkey").agg(group_digest("k", "o_orderstatus").alias("digest"))


@query("""select l_suppkey, sha256(string_agg(l, chr(10) order by l)) digest from (select distinct l_suppkey, l_partkey || ':' || l_returnflag l from lineitem) group by 1""")
def work_digest(t: Tables) -> DataFrame:
    rows = t("lineitem").select("l_suppkey", F.col("l_partkey").cast("string").alias("k"), "l_returnflag").distinct()
    return rows.groupBy("l_suppkey").agg(group_digest("k", "l_returnflag").alias("digest"))


TERMINAL = ("succeeded", "failed", "blocked")
RESULT = "o_custkey long, digest string, disposition string"


def closures(orders: DataFrame) -> DataFrame:
    """o_custkey, a digest of all that its result depends on, and the number of its orders."""
    o = orders.select("o_custkey", F.col("o_orderkey").cast("string").alias("k"), F.round(F.col("o_totalprice") * 1000).cast("long").cast("string").alias("price"), "o_orderstatus")
    return o.groupBy("o_custkey").agg(group_digest("k", "price", "o_orderstatus").alias("digest"), F.count("*").alias("n"))


CLOSURES = """select o_custkey k, sha256(string_agg(l, chr(10) order by l)) digest, count(*) n from (select o_custkey, o_orderkey || ':' || cast(round(o_totalprice * 1000) as bigint) || ':' || o_orderstatus l from {}) group by 1"""
RUNS = f"""b as materialized ({CLOSURES.format('orders')}), a as ({CLOSURES.format(PERTURBED)}), j as materialized (select b.k, coalesce(a.digest = b.digest and a.n <= 18, false) fresh from b left join a using (k))"""


def prior_results(t: Tables) -> DataFrame:
    """The stored results of a run over the orders as they were: of many orders it was cancelled, some failed."""
    end = F.when(F.col("n") > 18, "cancelled").when(F.col("n") % 5 == 0, "failed").otherwise("succeeded")
    runs = Generations(t.spark, shared_path(t.spark, "results"), RESULT)
    runs.commit(closures(compare.perturbed(t("orders"))).select("o_custkey", "digest", end.alias("disposition")))
    return runs.read()


def judged(now: DataFrame, prior: DataFrame) -> DataFrame:
    """now (o_custkey, digest) with current: whether the stored result is of the same digest and came to an end."""
    old = prior.select("o_custkey", F.col("digest").alias("prior"), "disposition")
    current = (F.col("prior") == F.col("digest")) & F.col("disposition").isin(*TERMINAL)
    return now.join(old, "o_custkey", "left").select("o_custkey", F.coalesce(current, F.lit(False)).alias("current"))


@query(f"""with recursive {RUNS},
s as materialized (select k, fresh, c_mktsegment in ('BUILDING', 'MACHINERY') required, c_acctbal < -500 stuck from j join customer on c_custkey = k),
run(k) as (select k from s where required and not fresh and not stuck union select s.k from run join s on s.k // 10 = run.k and s.k <> run.k where not s.stuck)
select s.k o_custkey, case when run.k is not null then 'run' when not required and not stuck then 'not_needed' when fresh and not stuck then 'unchanged' else 'blocked' end work from s left join run on run.k = s.k""")
def select_work(t: Tables) -> DataFrame:
    """What a run over the present orders has to do after one over the earlier ones. A customer depends on the one with
    its number without the last digit, and is run again after it unless it is blocked."""
    found = judged(closures(t("orders")), prior_results(t))
    facts = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("required"), (F.col("c_acctbal") < -500).alias("stuck"))
    state = stored(found.join(facts, "o_custkey"), "state")
    able = state.where("not stuck").select(F.col("o_custkey").alias("dst"), F.floor(F.col("o_custkey") / 10).alias("src")).where("src <> dst")
    again = reach(state.where("required and not current and not stuck").select(F.col("o_custkey").alias("node")), able)
    run = again.select(F.col("node").alias("o_custkey"), F.lit(True).alias("run"))
    work = F.when(F.col("run"), "run").when(~F.col("required") & ~F.col("stuck"), "not_needed").when(F.col("current") & ~F.col("stuck"), "unchanged").otherwise("blocked")
    return state.join(run, "o_custkey", "left").select("o_custkey", work.alias("work"))


@query(f"""with {RUNS} select k o_custkey, fresh current from j""")
def prior_current(t: Tables) -> DataFrame:
    return judged(closures(t("orders")), prior_results(t))


@query("""select l_orderkey, l_linenumber, count(*) n from lineitem where l_orderkey % 2 = 0 and l_orderkey % 10 <> 4 group by 1, 2""")
def reusable_results(t: Tables) -> DataFrame:
    now = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    earlier = now.where("l_orderkey % 2 = 0").distinct()
    selected = t("orders").where("o_orderkey % 10 = 4").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = now.join(earlier, ["l_orderkey", "l_linenumber", "l_partkey"], "left_semi").join(selected, "l_orderkey", "left_anti")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("""select l_orderkey, count(case when l_linestatus = 'F' then 1 end) = count(*) complete from lineitem group by 1""")
def complete_same_run(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg((F.count_if(F.col("l_linestatus") == "F") == F.count("*")).alias("complete"))


CURRENT = f"""p as materialized (select page_id, path, regexp_extract(path, '^[^/]*') script, split_part(path, '/', 2) parameters, sha256(html) fingerprint, html, length(html) n from (select page_id, html, {PATH_SQL} path from pages) s),
rec as (select path, sha256(case when n % 7 = 0 then html || '!' else html end) fingerprint, case when n % 5 = 0 then 'old' else script end script, parameters, n % 11 <> 0 confirmed from (select distinct on (path) * from p order by path, page_id) s where n % 3 <> 0),
m as (select page_id, n, fingerprint, script || '/' || parameters dir, script, parameters from p union all select page_id, n, fingerprint, script, script, '' from p),
now as (select dir, sha256(string_agg(page_id || ':' || fingerprint, chr(10) order by page_id || ':' || fingerprint)) fingerprint from m group by 1),
dirs as (select dir path, sha256(string_agg(page_id || ':' || fingerprint, chr(10) order by page_id || ':' || fingerprint) filter (n % 13 <> 0)) fingerprint, min(script) script, min(parameters) parameters, true confirmed from m where parameters = 'en' or (parameters = '' and ends_with(script, '.com')) group by 1)"""


@query(f"""with {CURRENT}, x as (select p.*, r.path rp, r.fingerprint rf, r.script rs, r.parameters ra, r.confirmed rc from p left join rec r using (path)),
c as (select x.page_id, count(*) k, min(d.path) path from x join dirs d on x.rp is null and starts_with(x.path, d.path || '/') group by 1),
j as (select x.page_id, case when rp is not null then 'exact' when k = 1 then 'directory' when k > 1 then 'ambiguous' else 'none' end how, coalesce(rc, d.confirmed) confirmed,
  list_filter([case when coalesce(now.fingerprint, x.fingerprint) is distinct from coalesce(rf, d.fingerprint) then 'fingerprint' end, case when x.script <> coalesce(rs, d.script) then 'script' end, case when x.parameters <> coalesce(ra, d.parameters) then 'parameters' end], lambda f: f is not null) fields
  from x left join c on c.page_id = x.page_id left join dirs d on c.k = 1 and d.path = c.path left join now on now.dir = d.path)
select page_id, case when how = 'ambiguous' then how when how = 'none' then 'unrecorded' when not confirmed then 'unconfirmed' when len(fields) > 0 then 'mismatch' else 'current' end state, case when how in ('exact', 'directory') and confirmed and len(fields) > 0 then fields end mismatches from j""")
def output_currentness(t: Tables) -> DataFrame:
    """Whether the record of each page, or of the one directory around it, still says what is there."""
    p = t("pages").select("page_id", url_path(F.col("url")).alias("path"), "html", F.length("html").alias("n"))
    p = p.select("*", F.split("path", "/")[0].alias("script"), F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit("")).alias("parameters"), F.sha2("html", 256).alias("fingerprint"))
    was = F.sha2(F.when(F.col("n") % 7 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256)
    row = F.struct("page_id", "n", was.alias("fingerprint"), F.when(F.col("n") % 5 == 0, "old").otherwise(F.col("script")).alias("script"), "parameters", (F.col("n") % 11 != 0).alias("confirmed"))
    records = p.groupBy("path").agg(F.min(row).alias("r")).where("r.n % 3 <> 0").select("path", "r.fingerprint", "r.script", "r.parameters", "r.confirmed")
    level = lambda path, parameters: F.struct(path.alias("directory"), parameters.alias("parameters"))
    members = p.select("page_id", "n", "fingerprint", "script", F.explode(F.array(level(F.concat_ws("/", "script", "parameters"), F.col("parameters")), level(F.col("script"), F.lit("")))).alias("l")).select("page_id", "n", "fingerprint", "script", "l.*")
    line = F.concat_ws(":", F.col("page_id").cast("string"), "fingerprint")
    digest = lambda lines: F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256)
    now = members.groupBy("directory").agg(digest(line).alias("covering_fingerprint"))
    kept = members.where((F.col("parameters") == "en") | ((F.col("parameters") == "") & F.col("script").endswith(".com"))).withColumn("line", F.when(F.col("n") % 13 != 0, line))
    count = F.count("line")
    directories = kept.groupBy(F.col("directory").alias("path")).agg(F.when(count > 0, digest("line")).alias("fingerprint"), F.min("script").alias("script"), F.min("parameters").alias("parameters"), F.lit(True).alias("confirmed"))
    found = resolved(p.drop("html", "n"), records, directories, "page_id").withColumn("directory", F.when(F.col("how") == "directory", F.col("record.path")))
    return currentness(found.join(now, "directory", "left"), ["fingerprint", "script", "parameters"]).select("page_id", "state", "mismatches")


@query("""select doc_id, case when doc_id % 9 = 0 then 'unrecorded' else 'mismatch' end problem from documents where doc_id % 9 = 0 or doc_id % 8 = 0""")
def fingerprint_mismatch(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("observed"))
    recorded = d.where("doc_id % 9 <> 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, "stale").otherwise(F.col("observed")).alias("recorded"))
    j = d.join(recorded, "doc_id", "left").where(~F.col("recorded").eqNullSafe(F.col("observed")))
    return j.select("doc_id", F.when(F.col("recorded").isNull(), "unrecorded").otherwise("mismatch").alias("problem"))


@query("""with b as (select l_orderkey k, count(*) filter (l_returnflag = 'R') n from lineitem group by 1) select o_orderkey, case when coalesce(n, 0) > 0 then 'excluded' else 'admitted' end verdict from orders left join b on k = o_orderkey""")
def admission(t: Tables) -> DataFrame:
    blockers = t("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("blockers"))
    j = t("orders").join(blockers, "o_orderkey", "left")
    return j.select("o_orderkey", F.when(F.size(F.coalesce("blockers", F.array())) > 0, "excluded").otherwise("admitted").alias("verdict"))


@query(f"""with p as (select page_id, {PATH_SQL} p from pages), a as (select page_id, unnest(list_transform(range(1, len(string_split(p, '/')) + 1), lambda i: array_to_string(string_split(p, '/')[1:i], '/'))) d from p),
f as (select d, count(*) n, count(*) filter (page_id % 2 = 0) o from a group by 1 having count(*) = count(*) filter (page_id % 2 = 0)),
k as (select a.page_id, a.d, row_number() over (partition by page_id order by length(a.d)) r from a join f using (d))
select distinct d directory from k where r = 1""")
def orphan_directories(t: Tables) -> DataFrame:
    """The highest directories all of whose pages are orphans (here: of even number)."""
    a = t("pages").select("page_id", F.explode(ancestors(url_path(F.col("url")))).alias("d"))
    full = a.groupBy("d").agg(F.count("*").alias("n"), F.count_if(F.col("page_id") % 2 == 0).alias("o")).where("n = o").select("d")
    return a.join(full, "d").groupBy("page_id").agg(F.min_by("d", F.length("d")).alias("directory")).select("directory").distinct()
