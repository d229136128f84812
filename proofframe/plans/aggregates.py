"""Queries over aggregations, windows, paging and set operations (AG, WN, SL, SO)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import compare
from ..operators.fixpoint import levels
from ..operators.order import ranked, running
from ..registry import Tables, query
from ..sources import files
from ..sources.fences import fenced_lines
from .joins import PERTURBED

TYPES = ["click", "error", "purchase", "signup", "view", "never"]


@query(f"""select c.event_type, count(e.event_id) n from (select unnest({TYPES}) event_type) c left join events e on e.event_type = c.event_type group by 1""")
def count_zero_filled(t: Tables) -> DataFrame:
    closed = t("region").limit(1).select(F.explode(F.array(*map(F.lit, TYPES))).alias("event_type"))
    counts = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return closed.join(counts, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("""select o_orderstatus, o_orderpriority, count(*) n from orders group by grouping sets ((o_orderstatus), (o_orderstatus, o_orderpriority), ())""")
def status_reason_counts(t: Tables) -> DataFrame:
    return t("orders").groupingSets([["o_orderstatus"], ["o_orderstatus", "o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""select count(*) filter (o_orderstatus = 'F') done, count(*) filter (o_orderstatus = 'O') "open", count(*) filter (o_orderstatus = 'P') partial from orders""")
def selection_pivot(t: Tables) -> DataFrame:
    return t("orders").agg(*(F.count_if(F.col("o_orderstatus") == k).alias(n) for k, n in (("F", "done"), ("O", "open"), ("P", "partial"))))


@query("""select r_name, n_name, sum(k)::bigint customers, count(k) covered from (select r_name, n_name, k from region join nation on n_regionkey = r_regionkey left join (select c_nationkey, count(*) k from customer where c_nationkey % 6 <> 0 group by 1) c on c_nationkey = n_nationkey) group by rollup (r_name, n_name)""")
def root_rollup(t: Tables) -> DataFrame:
    counts = t("customer").where("c_nationkey % 6 <> 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(counts, "n_nationkey", "left")
    return rows.rollup("r_name", "n_name").agg(F.sum("k").alias("customers"), F.count("k").alias("covered"))


@query("""select user_id, list_sort(list(distinct event_type)) types from events group by 1""")
def distinct_types(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))


@query("""select l_suppkey, count(distinct l_partkey) n from lineitem group by 1""")
def count_distinct(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n"))


@query("""select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1""")
def duplicate_keys(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("""select count(*) = 25 matches_ok, list_sort(list(n_nationkey))[1:3] = [0, 1, 2] identity_ok, count(distinct n_regionkey) = 4 shape_ok from nation""")
def check_expectations(t: Tables) -> DataFrame:
    first = F.slice(F.array_sort(F.collect_list("n_nationkey")), 1, 3)
    return t("nation").agg((F.count("*") == 25).alias("matches_ok"), (first == F.array(*map(F.lit, (0, 1, 2)))).alias("identity_ok"), (F.count_distinct("n_regionkey") == 4).alias("shape_ok"))


@query("""with d as (select sha256(text) target, source, doc_id from documents), c as (select target, count(distinct source) declared from d group by 1 having count(distinct source) > 1) select target, declared, doc_id "owner" from c join d using (target)""")
def declaration_conflicts(t: Tables) -> DataFrame:
    """Texts that several sources declare, a row for each document that does."""
    d = t("documents").select(F.sha2("text", 256).alias("target"), "source", F.col("doc_id").alias("owner"))
    several = d.groupBy("target").agg(F.count_distinct("source").alias("declared")).where("declared > 1")
    return d.join(several, "target").select("target", "declared", "owner")


@query("""select user_id, case when s = 0 then 'none' else 'several' end ambiguity, s producers from (select user_id, count(*) filter (event_type = 'signup') s from events group by 1) where s <> 1""")
def producer_ambiguity(t: Tables) -> DataFrame:
    n = t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("producers")).where("producers <> 1")
    return n.select("user_id", F.when(F.col("producers") == 0, "none").otherwise("several").alias("ambiguity"), "producers")


@query("""select l_orderkey, count(distinct l_returnflag) variants from lineitem group by 1 having count(distinct l_returnflag) > 1""")
def node_conflicts(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("variants")).where("variants > 1")


@query("""select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_returnflag, l_partkey, l_suppkey) k from lineitem) where k = 1""")
def dedupe_priority(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_partkey", F.struct("l_returnflag", "l_partkey", "l_suppkey")).alias("l_partkey"))


@query("""select count(*) n, sum(strlen(text) + strlen(source))::bigint bytes, sum(strlen(text) + strlen(source)) > 1000000 over_budget from documents""")
def byte_budget(t: Tables) -> DataFrame:
    bytes_ = F.sum(F.octet_length("text") + F.octet_length("source"))
    return t("documents").agg(F.count("*").alias("n"), bytes_.alias("bytes"), (bytes_ > 1000000).alias("over_budget"))


@query("""select l.lang, s.source from (select distinct lang from documents) l, (select distinct source from documents) s where not exists (select 1 from documents d where d.lang = l.lang and d.source = s.source and d.n_chars > 6000)""")
def coverage_gaps(t: Tables) -> DataFrame:
    d = t("documents")
    langs = d.agg(F.collect_set("lang").alias("langs"))  # the closed list of categories, one row
    grid = d.select("source").distinct().join(F.broadcast(langs)).select(F.explode("langs").alias("lang"), "source")
    return grid.join(d.where("n_chars > 6000"), ["lang", "source"], "left_anti")


@query("""select doc_id, 'inconsistent' rule from labels where quality = 1 and toxic = 1 union all select doc_id, 'duplicate' from labels group by doc_id having count(*) > 1 union all select doc_id, 'low' from labels where quality = 0""")
def case_rule_violations(t: Tables) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("doc_id"))
    rules = F.array_compact(F.array(F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "inconsistent"), F.when(F.col("n") > 1, "duplicate"), F.when(F.col("quality") == 0, "low")))
    return t("labels").withColumn("n", n).select("doc_id", F.explode(rules).alias("rule"))


@query("""select d.lang, avg(case when (n_chars > 300) = (quality = 1) then 1.0 else 0.0 end)::double pass_rate, count(*) n from labels join documents d using (doc_id) group by 1""")
def eval_pass_rate(t: Tables) -> DataFrame:
    passed = ((F.col("n_chars") > 300) == (F.col("quality") == 1)).cast("double")
    return t("labels").join(t("documents"), "doc_id").groupBy("lang").agg(F.avg(passed).alias("pass_rate"), F.count("*").alias("n"))


@query("""select user_id, count(*) members, list_sort(list(distinct ts::date::varchar)) keys, min(case when value > 50 then event_id end) focus from events where event_type = 'error' group by 1""")
def component_profile(t: Tables) -> DataFrame:
    e = t("events").where("event_type = 'error'")
    return e.groupBy("user_id").agg(F.count("*").alias("members"), F.array_sort(F.collect_set(F.to_date("ts").cast("string"))).alias("keys"), F.min(F.when(F.col("value") > 50, F.col("event_id"))).alias("focus"))


@query(r"""select doc_id, len(regexp_extract_all(text, '[Tt]he '))::bigint n, len(regexp_extract_all(text, '[Tt]he ')) >= 1 and not contains(text, 'idiot') ok from documents""")
def verify_occurrence(t: Tables) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit("[Tt]he "), F.lit(0))).cast("long")
    return t("documents").select("doc_id", n.alias("n"), ((n >= 1) & ~F.col("text").contains("idiot")).alias("ok"))


@query("""select event_id, k > coalesce(lag(k) over (partition by user_id order by event_id), 0) boundary, k from (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id)::bigint k from events)""")
def new_boundary(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t("events").withColumn("k", F.sum((F.col("event_type") == "error").cast("long")).over(w))
    return e.select("event_id", (F.col("k") > F.coalesce(F.lag("k").over(w), F.lit(0))).alias("boundary"), "k")


@query("""select conv_id, min(turn) turn from (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) p from conversations) where role = 'user' and p = 'assistant' group by 1""")
def first_after_flip(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t("conversations").withColumn("p", F.lag("role").over(w))
    return c.where("role = 'user' and p = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("turn"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents)
select doc_id, line_no::bigint line_no, last_value(case when regexp_matches(line, '^[A-Z][^ ]*\.') then left(line, 12) end ignore nulls) over (partition by doc_id order by line_no) section from l""")
def section_of_line(t: Tables) -> DataFrame:
    """Every line of documents with the last heading up to it."""
    lines = files.lines(t("documents"), "text", "doc_id")
    head = F.when(F.col("line").rlike(r"^[A-Z][^ ]*\."), F.left("line", F.lit(12)))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.last(head, ignorenulls=True).over(w).alias("section"))


MARKED = r"""(select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(^|\n)(The|La|Der|El)( [^\n]*)?', '\1```\3', 'g'), '(^|\n)(Of|De|Die|Los) ?', '\1  ~~~~', 'g'), '(^|\n)(And|Et|Und|Y)[^\n]*', '\1`````  ', 'g') as text from documents)"""


@query(rf"""with recursive l as materialized (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from {MARKED}),
r(doc_id, i, fence, inside) as (select doc_id, 0, '', false from documents where text is not null union all
select l.doc_id, l.i, case when r.fence = '' then regexp_extract(l.line, '^\s*(```+|~~~+)', 1) when regexp_full_match(l.line, '\s*' || left(r.fence, 1) || '{{' || length(r.fence) || ',}}\s*') then '' else r.fence end,
r.fence <> '' or regexp_matches(l.line, '^\s*(```|~~~)') from r join l on l.doc_id = r.doc_id and l.i = r.i + 1)
select doc_id, i::bigint line_no, inside from r where i > 0""")
def fence_parity(t: Tables) -> DataFrame:
    """Lines of documents, with fences put in for some first words, and whether they are in a fenced block."""
    text = F.regexp_replace("text", r"(^|\n)(The|La|Der|El)(?:( [^\n]*)|)", "$1```$3")
    text = F.regexp_replace(F.regexp_replace(text, r"(^|\n)(Of|De|Die|Los) ?", "$1  ~~~~"), r"(^|\n)(And|Et|Und|Y)[^\n]*", "$1`````  ")
    return fenced_lines(t("documents").select("doc_id", text.alias("text")), "text", "doc_id")


@query("""select conv_id, case when list_contains(r, 'system') and list_contains(r, 'assistant') then 'experimental' when list_contains(r, 'assistant') then 'synthesis' when list_contains(r, 'user') then 'prose' else 'invalid' end kind from (select conv_id, list(distinct role) r from conversations group by 1)""")
def classify_section(t: Tables) -> DataFrame:
    r = t("conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    has = lambda x: F.array_contains("r", x)
    return r.select("conv_id", F.when(has("system") & has("assistant"), "experimental").when(has("assistant"), "synthesis").when(has("user"), "prose").otherwise("invalid").alias("kind"))


@query("""select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_totalprice desc, o_orderkey desc) k from orders) where k = 1""")
def latest_run(t: Tables) -> DataFrame:
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("""select event_id, max(value) over w peak, last_value(case when event_type = 'view' then value end ignore nulls) over w last_view from events window w as (partition by user_id order by event_id)""")
def peak_and_last(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    view = F.when(F.col("event_type") == "view", F.col("value"))
    return t("events").select("event_id", F.max("value").over(w).alias("peak"), F.last(view, ignorenulls=True).over(w).alias("last_view"))


@query("""select source, doc_id, bytes from (select source, doc_id, sum(strlen(text)) over (partition by source order by doc_id)::bigint bytes from documents) where bytes <= 16384""")
def page_by_bytes(t: Tables) -> DataFrame:
    """The leading documents of each source, as far as their texts stay within the budget."""
    rows = t("documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    paged = running(rows, ["source"], [F.col("doc_id")], F.col("size"), "bytes")
    return paged.where("bytes <= 16384").select("source", "doc_id", "bytes")


@query("""select conv_id, turn, row_number() over (order by conv_id, turn) - 1 seq from conversations""")
def global_sequence(t: Tables) -> DataFrame:
    """Turns of all conversations numbered in one order."""
    c = ranked(t("conversations").select("conv_id", "turn"), [F.col("conv_id"), F.col("turn")], "seq")
    return c.select("conv_id", "turn", (F.col("seq") - 1).alias("seq"))


@query("""select o_orderkey from orders where o_orderkey > 500 order by 1 limit 101""")
def keyset_page(t: Tables) -> DataFrame:
    return t("orders").where("o_orderkey > 500").select("o_orderkey").orderBy("o_orderkey").limit(101)


@query("""select o_orderkey, (select count(*) from orders where o_orderstatus = 'O') matched from orders where o_orderstatus = 'O' order by 1 limit 50 offset 100""")
def offset_page(t: Tables) -> DataFrame:
    rows = t("orders").where("o_orderstatus = 'O'").select("o_orderkey")
    total = rows.agg(F.count("*").alias("matched"))
    return rows.orderBy("o_orderkey").offset(100).limit(50).join(F.broadcast(total))


@query(f"""select o_orderkey, cast(a as varchar) "expected", cast(b as varchar) found, total, total > 16 truncated from (select o_orderkey, a.o_totalprice a, b.o_totalprice b, row_number() over (order by o_orderkey) k, count(*) over () total from orders a join {PERTURBED} b using (o_orderkey) where a.o_totalprice <> b.o_totalprice) where k <= 16""")
def first_k_differences(t: Tables) -> DataFrame:
    d = compare.cell_diff(t("orders"), compare.perturbed(t("orders")), ["o_orderkey"], ["o_totalprice"]).where("field is not null")
    total = d.agg(F.count("*").alias("total"))
    first = d.orderBy("o_orderkey").limit(16).join(F.broadcast(total))
    return first.select("o_orderkey", "expected", "found", "total", (F.col("total") > 16).alias("truncated"))


def foreign_keys(t: Tables) -> DataFrame:
    """Edges region to nation to customer to orders, nodes named kind:key."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    a = t("nation").select(name("region", "n_regionkey").alias("src"), name("nation", "n_nationkey").alias("dst"))
    b = t("customer").select(name("nation", "c_nationkey").alias("src"), name("customer", "c_custkey").alias("dst"))
    c = t("orders").select(name("customer", "o_custkey").alias("src"), name("order", "o_orderkey").alias("dst"))
    return a.unionByName(b).unionByName(c)


@query("""select 'region:' || r_regionkey node, 0 "level" from region where r_regionkey in (select n_regionkey from nation) union all select 'nation:' || n_nationkey, 1 from nation union all select 'customer:' || c_custkey, 2 from customer union all select 'order:' || o_orderkey, 3 from orders""")
def dependency_levels(t: Tables) -> DataFrame:
    return levels(foreign_keys(t))[0]


@query("""select p_partkey from part where p_brand <> 'Brand#12' and p_partkey not in (select l_partkey from lineitem where l_shipdate < timestamp '1993-01-01')""")
def orphans(t: Tables) -> DataFrame:
    connected = t("lineitem").where(F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp_ntz")).select(F.col("l_partkey").alias("p_partkey"))
    retained = t("part").where("p_brand = 'Brand#12'").select("p_partkey")
    return t("part").select("p_partkey").join(connected, "p_partkey", "left_anti").join(retained, "p_partkey", "left_anti")


@query("""select c_nationkey k from customer union select s_nationkey from supplier""")
def union_distinct(t: Tables) -> DataFrame:
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("""with a as (select distinct l_partkey k from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey k from lineitem where l_linestatus = 'O'), c as (select p_partkey k from part where p_size < 10)
select 'a_b' pair, count(*) n from (select k from a intersect select k from b) union all select 'a_c', count(*) from (select k from a intersect select k from c) union all select 'b_c', count(*) from (select k from b intersect select k from c)""")
def coverage_overlap(t: Tables) -> DataFrame:
    l = t("lineitem")  # noqa: E741
    sets = {"a": l.where("l_returnflag = 'R'").select("l_partkey"), "b": l.where("l_linestatus = 'O'").select("l_partkey"), "c": t("part").where("p_size < 10").select("p_partkey")}
    out = [sets[x].intersect(sets[y]).agg(F.count("*").alias("n")).select(F.lit(f"{x}_{y}").alias("pair"), "n") for x, y in ("ab", "ac", "bc")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""select p_partkey, case when n is null then 'unused' else 'reused' end issue, coalesce(n, 0) n from part left join (select l_partkey, count(*) n from lineitem where l_returnflag = 'A' and l_linenumber = 1 group by 1) on l_partkey = p_partkey where n is null or n > 1""")
def unused_and_reused(t: Tables) -> DataFrame:
    used = t("lineitem").where("l_returnflag = 'A' and l_linenumber = 1").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t("part").select("p_partkey").join(used, "p_partkey", "left").where("n is null or n > 1").select("p_partkey", F.when(F.col("n").isNull(), "unused").otherwise("reused").alias("issue"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""select s_suppkey, case when s_suppkey % 7 = 0 then 'renamed ' || s_name else s_name end s_name from supplier where s_suppkey % 11 <> 0 union all select s_suppkey + 1000000, s_name from supplier where s_suppkey % 13 = 0""")
def apply_changeset(t: Tables) -> DataFrame:
    s = t("supplier").select("s_suppkey", "s_name")
    deleted, added = s.where("s_suppkey % 11 = 0"), s.where("s_suppkey % 13 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1000000)
    renamed = s.where("s_suppkey % 7 = 0").select("s_suppkey", F.concat(F.lit("renamed "), "s_name").alias("new"))
    kept = s.join(deleted, "s_suppkey", "left_anti").join(renamed, "s_suppkey", "left").select("s_suppkey", F.coalesce("new", "s_name").alias("s_name"))
    clash = added.join(kept, "s_suppkey", "left_semi").limit(1).count()
    if clash:
        raise ValueError("an added key exists")
    return kept.unionByName(added)
