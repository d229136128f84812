"""Queries over joins (JN1 to JN23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import compare
from ..operators.fixpoint import ancestors
from ..registry import Tables, query

PATH_SQL = "regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', '')"


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "^[^:]*://", ""), "[?#].*$", "")


@query("""select c_custkey, count(*) n from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by 1""")
def join_bridge(t: Tables) -> DataFrame:
    c, o, l = t("customer").where("c_mktsegment = 'BUILDING'"), t("orders"), t("lineitem")  # noqa: E741
    return c.join(o, c["c_custkey"] == o["o_custkey"]).join(l, o["o_orderkey"] == l["l_orderkey"]).groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("""select c_custkey, c_name from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderstatus = 'P')""")
def semi_exists(t: Tables) -> DataFrame:
    partly = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(partly, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""select c_custkey from customer c where c_acctbal < 0 or exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderpriority = '1-URGENT')""")
def semi_or_local(t: Tables) -> DataFrame:
    urgent = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    return t("customer").join(urgent, "c_custkey", "left").where("c_acctbal < 0 or hit").select("c_custkey")


@query("""select k, count(distinct o_orderkey) n from (select c_nationkey k, o_orderkey from orders join customer on o_custkey = c_custkey union select s_nationkey, l_orderkey from lineitem join supplier on l_suppkey = s_suppkey) group by 1""")
def incident_edges(t: Tables) -> DataFrame:
    o, c, l, s = t("orders"), t("customer"), t("lineitem"), t("supplier")  # noqa: E741
    subject = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("k"), "o_orderkey")
    target = l.join(s, l["l_suppkey"] == s["s_suppkey"]).select(F.col("s_nationkey").alias("k"), F.col("l_orderkey").alias("o_orderkey"))
    return subject.union(target).distinct().groupBy("k").agg(F.count("*").alias("n"))


QUARTER = "l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '1995-04-01'"


@query(f"""select p_partkey from part where p_partkey not in (select l_partkey from lineitem where {QUARTER})""")
def unused_declared(t: Tables) -> DataFrame:
    sold = t("lineitem").where(F.col("l_shipdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-03-31 23:59:59.999999").cast("timestamp_ntz")))
    return t("part").join(sold.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("""select o_custkey producer, list_sort(list(o_orderkey)) missing from orders where o_orderkey not in (select l_orderkey from lineitem) group by 1""")
def missing_outputs(t: Tables) -> DataFrame:
    there = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    lost = t("orders").join(there, "o_orderkey", "left_anti")
    return lost.groupBy(F.col("o_custkey").alias("producer")).agg(F.array_sort(F.collect_set("o_orderkey")).alias("missing"))


@query("""select 'order' kind, o_orderkey id from orders where o_custkey % 50 = 0 union all select 'line', l_orderkey from (select distinct l_orderkey from lineitem) where l_orderkey % 1000 = 0""")
def referential_violations(t: Tables) -> DataFrame:
    customers = t("customer").where("c_custkey % 50 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = t("orders").where("o_orderkey % 1000 <> 0").select(F.col("o_orderkey").alias("id"))
    a = t("orders").join(customers, "o_custkey", "left_anti").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    b = t("lineitem").select(F.col("l_orderkey").alias("id")).distinct().join(orders, "id", "left_anti").select(F.lit("line").alias("kind"), "id")
    return a.unionByName(b)


PERTURBED = """(select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 97 = 0 then round(o_totalprice + 0.02, 2) when o_orderkey % 89 = 0 then round(o_totalprice + 0.005, 3) else o_totalprice end o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 101 <> 0)"""


@query(f"""select case when b.o_orderkey is null then 'missing' when a.o_totalprice <> b.o_totalprice then 'stale' else 'unchanged' end change, count(*) n from orders a left join {PERTURBED} b using (o_orderkey) group by 1""")
def classify_changes(t: Tables) -> DataFrame:
    found = compare.delta(t("orders"), compare.perturbed(t("orders")), ["o_orderkey"], ["o_totalprice", "o_orderstatus"])
    name = F.when(F.col("change") == "deleted", "missing").when(F.col("change") == "changed", "stale").when(F.col("change") == "added", "new").otherwise("unchanged")
    return found.groupBy(name.alias("change")).agg(F.count("*").alias("n"))


@query(f"""select o_orderkey, case when b.o_orderkey is null then 'deleted' else 'changed' end change from orders a left join {PERTURBED} b using (o_orderkey) where b.o_orderkey is null or a.o_totalprice <> b.o_totalprice""")
def state_delta(t: Tables) -> DataFrame:
    def state(df: DataFrame) -> DataFrame:
        return df.select("o_orderkey", F.sha2(F.col("o_totalprice").cast("string"), 256).alias("digest"))

    return compare.delta(state(t("orders")), state(compare.perturbed(t("orders"))), ["o_orderkey"], ["digest"]).where("change <> 'same'")


@query("""with s as (select p_brand, max(p_size) m from part group by 1), b as (select p_brand, 45 + cast(right(p_brand, 1) as integer) m from part where p_brand <> 'Brand#11' group by 1, 2 union all select 'Brand#99', 10)
select coalesce(s.p_brand, b.p_brand) p_brand, case when b.m is null then 'new' when s.m is null then 'retired' when s.m > b.m then 'grown' else 'kept' end issue from s full join b on s.p_brand = b.p_brand""")
def ratchet_issues(t: Tables) -> DataFrame:
    now = t("part").groupBy("p_brand").agg(F.max("p_size").alias("m"))
    base = t("part").where("p_brand <> 'Brand#11'").select("p_brand", (F.lit(45) + F.right("p_brand", F.lit(1)).cast("int")).alias("m")).distinct()
    base = base.unionByName(t("region").limit(1).select(F.lit("Brand#99").alias("p_brand"), F.lit(10).alias("m")))
    issue = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "retired").when(F.col("a.m") > F.col("b.m"), "grown").otherwise("kept")
    return compare.full(now, base, ["p_brand"]).select("p_brand", issue.alias("issue"))


@query("""select coalesce(d.doc_id, l.doc_id) doc_id, case when l.doc_id is null then 'no_presentation' when d.doc_id is null then 'no_record' when (l.quality = 1) <> (d.n_chars > 100) then 'mismatch' else 'ok' end outcome
from (select doc_id, n_chars from documents where doc_id % 7 <> 0) d full join labels l on d.doc_id = l.doc_id""")
def associate_records(t: Tables) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    outcome = F.when(b.isNull(), "no_presentation").when(a.isNull(), "no_record").when((b["quality"] == 1) != (a["n_chars"] > 100), "mismatch").otherwise("ok")
    return compare.full(t("documents").where("doc_id % 7 <> 0").select("doc_id", "n_chars"), t("labels"), ["doc_id"]).select("doc_id", outcome.alias("outcome"))


@query("""select l_orderkey, l_linenumber, l_partkey, case when p.p_partkey is null then 'unresolved' when p.p_size > 25 then 'equal' else 'different' end outcome from lineitem left join (select * from part where p_partkey % 10 <> 0) p on p.p_partkey = l_partkey""")
def resolve_references(t: Tables) -> DataFrame:
    p = t("part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    outcome = F.when(F.col("p_size").isNull(), "unresolved").when(F.col("p_size") > 25, "equal").otherwise("different")
    return t("lineitem").join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", outcome.alias("outcome"))


@query("""select c.event_id, count(p.event_id) candidates, case when count(p.event_id) = 0 then 'missing' when count(p.event_id) = 1 then 'unique' else 'ambiguous' end outcome, case when count(p.event_id) = 1 then min(p.event_id) end producer
from events c left join events p on p.user_id = c.user_id and p.event_type = 'signup' and p.event_id < c.event_id where c.event_type = 'purchase' group by 1""")
def unique_prior_producer(t: Tables) -> DataFrame:
    """Producers are counted by a running window over the user's events, so no pair of events is joined."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    made = F.when(F.col("event_type") == "signup", F.col("event_id"))
    e = t("events").where("event_type in ('signup', 'purchase')").select("event_id", "event_type", F.count(made).over(w).alias("candidates"), F.max(made).over(w).alias("last"))
    outcome = F.when(F.col("candidates") == 0, "missing").when(F.col("candidates") == 1, "unique").otherwise("ambiguous")
    return e.where("event_type = 'purchase'").select("event_id", "candidates", outcome.alias("outcome"), F.when(F.col("candidates") == 1, F.col("last")).alias("producer"))


OWNERS = f"""(select distinct regexp_extract(p, '^[^/]*/[^/]*') o from (select {PATH_SQL} p from pages) where p like '%/%/%')"""


def owners(t: Tables) -> DataFrame:
    """Host and language of pages, as owning directories."""
    p = url_path(F.col("url"))
    return t("pages").where(p.like("%/%/%")).select(F.regexp_extract(p, "^[^/]*/[^/]*", 0).alias("owner")).distinct()


def owned(t: Tables) -> DataFrame:
    pages = t("pages").select("page_id", url_path(F.col("url")).alias("path"))
    return pages.select("page_id", "path", F.explode(ancestors(F.col("path"))).alias("owner")).join(owners(t), "owner")


@query(f"""select page_id, o as "owner", case when p = o then 'exact' else 'contained' end relation from (select page_id, {PATH_SQL} p from pages) join {OWNERS} on p = o or starts_with(p, o || '/')""")
def path_overlap_join(t: Tables) -> DataFrame:
    return owned(t).select("page_id", "owner", F.when(F.col("path") == F.col("owner"), "exact").otherwise("contained").alias("relation"))


@query(f"""select o as "owner", count(*) n from (select {PATH_SQL} p from pages) join {OWNERS} on starts_with(p, o || '/') group by 1 having count(*) > 1""")
def overlapping_owners(t: Tables) -> DataFrame:
    return owned(t).where("path <> owner").groupBy("owner").agg(F.count("*").alias("n")).where("n > 1")


@query("""select a.event_id a, b.event_id b from events a join events b on a.user_id = b.user_id and a.event_id < b.event_id and a.ts::date = b.ts::date where a.event_type in ('purchase', 'signup') or b.event_type in ('purchase', 'signup')""")
def claim_conflicts(t: Tables) -> DataFrame:
    """Pairs of a user's events of one day of which one writes at least. Only those that write are joined with the others,
    so that no pair of two readers is made; a pair of two that write is met twice and kept once."""
    key = ["user_id", "day"]
    write = F.coalesce(F.col("event_type").isin("purchase", "signup"), F.lit(False))
    e = t("events").select("event_id", "user_id", F.to_date("ts").alias("day"), write.alias("write"))
    writers = e.where("write").select(*key, F.col("event_id").alias("writer"))
    pairs = e.join(writers, key).where("event_id < writer or (event_id > writer and not write)")
    return pairs.select(F.least("event_id", "writer").alias("a"), F.greatest("event_id", "writer").alias("b"))


@query(f"""select distinct o as "owner", page_id from (select page_id, {PATH_SQL} p from pages where page_id % 5 <> 0) join {OWNERS} on p = o or starts_with(p, o || '/')""")
def consumers_of_targets(t: Tables) -> DataFrame:
    """Owners and their consumers, a row for each pair; every fifth page is retained and exempt."""
    return owned(t).where("page_id % 5 <> 0").select("owner", "page_id").distinct()


@query("""select p_partkey, max(case when starts_with(p_type || ' ', x || ' ') then x end) prefix from part left join (select distinct split_part(p_type, ' ', 1) x from part union select distinct split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2) from part where p_partkey % 2 = 0) on true group by 1""")
def longest_prefix(t: Tables) -> DataFrame:
    word = F.split("p_type", " ")
    known = t("part").select(word[0].alias("prefix")).union(t("part").where("p_partkey % 2 = 0").select(F.array_join(F.slice(word, 1, 2), " "))).distinct()
    tries = t("part").select("p_partkey", F.explode(ancestors(F.col("p_type"), " ")).alias("prefix"))
    return tries.join(known, "prefix").groupBy("p_partkey").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


@query("""with s as (select user_id, date_trunc('day', ts) d, min(ts) a, max(ts) b from events group by 1, 2 union all select user_id, date_trunc('month', ts), min(ts), max(ts) from events group by 1, 2),
j as (select e.event_id, epoch_us(s.b) - epoch_us(s.a) w, row_number() over (partition by e.event_id order by epoch_us(s.b) - epoch_us(s.a), s.a) k from events e join s on s.user_id = e.user_id and e.ts between s.a and s.b)
select event_id, w as width_us from j where k = 1""")
def narrowest_span(t: Tables) -> DataFrame:
    """Spans are joined by user and month, in which either kind of span lies."""
    e = t("events").withColumn("month", F.date_trunc("month", "ts")).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = [e.groupBy("user_id", "month", F.date_trunc(k, "ts").alias("part")).agg(F.min("us").alias("a"), F.max("us").alias("b")).select("user_id", "month", "a", "b") for k in ("day", "month")]
    spans = spans[0].unionByName(spans[1])
    return e.join(spans, ["user_id", "month"]).where("us between a and b").groupBy("event_id").agg(F.min(F.col("b") - F.col("a")).alias("width_us"))


TERMS = [("license", "src0"), ("idiot", "src1"), ("the", "src2")]


@query("""select doc_id, term from documents, (values ('license', 'src0'), ('idiot', 'src1'), ('the', 'src2')) v(term, allowed) where contains(lower(text), term) and source <> allowed""")
def stale_terms(t: Tables) -> DataFrame:
    """A short fixed list of terms is tested in each row, no rows are paired."""
    hits = F.array_compact(F.array(*(F.when(F.lower("text").contains(term) & (F.col("source") != allowed), F.lit(term)) for term, allowed in TERMS)))
    return t("documents").select("doc_id", F.explode(hits).alias("term"))


@query(f"""select o_orderkey, list_filter([case when a.o_totalprice <> b.o_totalprice then 'o_totalprice' end, case when a.o_orderstatus <> b.o_orderstatus then 'o_orderstatus' end], lambda x: x is not null) fields from orders a join {PERTURBED} b using (o_orderkey) where a.o_totalprice <> b.o_totalprice""")
def mismatched_fields(t: Tables) -> DataFrame:
    both = compare.full(t("orders"), compare.perturbed(t("orders")), ["o_orderkey"]).where("a is not null and b is not null")
    fields = F.array_compact(F.array(*(F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(c)) for c in ("o_totalprice", "o_orderstatus"))))
    return both.select("o_orderkey", fields.alias("fields")).where(F.size("fields") > 0)


@query("""with b as (select s_suppkey blocker, s_nationkey k, case when s_suppkey % 10 = 0 then 'log' when s_suppkey % 10 < 4 then 'entry' else 'node' end scope from supplier)
select blocker, scope, case when scope = 'entry' then k end c_nationkey, case when scope = 'node' then blocker end c_custkey, count(*) customers from customer join b on scope = 'log' or (scope = 'entry' and c_nationkey = k) or (scope = 'node' and c_custkey = blocker) group by all""")
def attach_scoped(t: Tables) -> DataFrame:
    """All blockers that reach a customer, one row each: whom they block (log: everyone, entry: the customers of
    c_nationkey, node: c_custkey) and how many those are. Pairs would be customers x blockers."""
    k = F.col("s_suppkey") % 10
    scope = F.when(k == 0, "log").when(k < 4, "entry").otherwise("node")
    b = t("supplier").select(F.col("s_suppkey").alias("blocker"), scope.alias("scope"), F.col("s_nationkey").alias("k"))
    b = b.select("blocker", "scope", F.when(F.col("scope") == "entry", F.col("k")).alias("c_nationkey"), F.when(F.col("scope") == "node", F.col("blocker")).alias("c_custkey"))
    c = t("customer").select("c_custkey", "c_nationkey")
    log = b.where("scope = 'log'").join(F.broadcast(c.agg(F.count("*").alias("customers"))))  # one row
    entry = b.where("scope = 'entry'").join(c.groupBy("c_nationkey").agg(F.count("*").alias("customers")), "c_nationkey")
    node = b.where("scope = 'node'").join(c.groupBy("c_custkey").agg(F.count("*").alias("customers")), "c_custkey")
    return log.unionByName(entry).unionByName(node).where("customers > 0")


@query(r"""with l as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) link from pages) select link, count(*) n from l where link not in (select url from pages) group by 1""")
def broken_links(t: Tables) -> DataFrame:
    links = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
    return links.join(t("pages").select(F.col("url").alias("link")), "link", "left_anti").groupBy("link").agg(F.count("*").alias("n"))
