"""Queries over lineage graphs and check dependencies (GR1 to GR26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..operators.components import components
from ..operators.cycles import cycles
from ..operators.fixpoint import DEPTH, neighbourhood, reach
from ..operators.support import directory_inputs
from ..registry import Tables, query
from ..storage import stored
from .aggregates import foreign_keys
from .joins import PATH_SQL, owned, url_path

FK_SQL = """(select 'region:' || n_regionkey src, 'nation:' || n_nationkey dst from nation union all select 'nation:' || c_nationkey, 'customer:' || c_custkey from customer union all select 'customer:' || o_custkey, 'order:' || o_orderkey from orders)"""


@query(f"""select split_part(src, ':', 1) kind, src, dst from {FK_SQL}""")
def build_graph(t: Tables) -> DataFrame:
    e = foreign_keys(t)
    clash = e.groupBy("dst").agg(F.count_distinct("src").alias("n")).where("n > 1").limit(1).count()
    if clash:
        raise ValueError("a node has two owners")
    return e.select(F.split("src", ":")[0].alias("kind"), "src", "dst")


def day() -> WindowSpec:
    """A user's events of one day in order: a chain."""
    return Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")


def is_error() -> Column:
    return F.col("event_type") == "error"


def sessions(t: Tables) -> DataFrame:
    """Event to next event of its user on the same day: chains as dependency edges."""
    return t("events").select("event_id", "event_type", F.lead("event_id").over(day()).alias("next")).where("next is not null")


CHAIN = """(select event_id src, lead(event_id) over (partition by user_id, ts::date order by ts, event_id) dst, event_type from events)"""


@query("""with p as (select user_id, ts::date d, min(event_id) e, count(*) n from events where event_type = 'signup' group by 1, 2) select c.event_id consumer, p.e producer from events c join p on p.user_id = c.user_id and p.d = c.ts::date and p.n = 1 and p.e < c.event_id where c.event_type = 'purchase'""")
def execution_edges(t: Tables) -> DataFrame:
    e = t("events").withColumn("day", F.to_date("ts"))
    p = e.where("event_type = 'signup'").groupBy("user_id", "day").agg(F.min("event_id").alias("producer"), F.count("*").alias("n")).where("n = 1")
    c = e.where("event_type = 'purchase'").select(F.col("event_id").alias("consumer"), "user_id", "day")
    return c.join(p, ["user_id", "day"]).where("producer < consumer").select("consumer", "producer")


@query(f"""with recursive r(node, depth) as (select 'region:1', 0 union select dst, depth + 1 from r join {FK_SQL} on src = node) select node, depth from r""")
def reachable_from_roots(t: Tables) -> DataFrame:
    seeds = t("region").where("r_regionkey = 1").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"))
    return reach(seeds, foreign_keys(t))


@query(f"""with recursive r(root, node, depth) as (select dst, dst, 0 from {FK_SQL} where src = 'region:2' union select root, dst, depth + 1 from r join {FK_SQL} on src = node) select root, count(*) nodes, max(depth) depth from r group by 1""")
def lineage_many(t: Tables) -> DataFrame:
    e = foreign_keys(t)
    seeds = e.where("src = 'region:2'").select(F.col("dst").alias("root"), F.col("dst").alias("node"))
    return reach(seeds, e, ("root",)).groupBy("root").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


@query(f"""with recursive bad as (select 'customer:' || c_custkey node from customer where c_custkey % 2 = 0),
r(node, depth) as (select 'region:3', 0 union select dst, depth + 1 from r join {FK_SQL} on src = r.node where r.node not in (select node from bad))
select node, depth, case when node in (select node from bad) then 'failed' else 'ok' end outcome from r""")
def lineage_defects(t: Tables) -> DataFrame:
    """Walk from region 3; nodes of even customers are failed: they are reported and end their own branch only."""
    e = foreign_keys(t)
    failed = t("customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"))
    walked = reach(t("region").where("r_regionkey = 3").select(F.lit("region:3").alias("node")), e, depth=DEPTH, stop=failed)
    hit = failed.withColumn("defect", F.lit("failed"))
    return walked.join(hit, "node", "left").select("node", "depth", F.coalesce("defect", F.lit("ok")).alias("outcome"))


@query("""select l_partkey origin, case when count(distinct l_suppkey) > 1 then 'ambiguous' else 'invalid' end conflict from lineitem where l_partkey % 10 = 0 and l_returnflag = 'R' group by 1""")
def origin_conflicts(t: Tables) -> DataFrame:
    origins = t("part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("l_partkey"))
    made = t("lineitem").where("l_returnflag = 'R'").join(origins, "l_partkey", "left_semi").groupBy(F.col("l_partkey").alias("origin")).agg(F.count_distinct("l_suppkey").alias("n"))
    return made.select("origin", F.when(F.col("n") > 1, "ambiguous").otherwise("invalid").alias("conflict"))


PRODUCED = f"""(select regexp_extract(p, '^[^/]*/[^/]*') o, p, page_id, page_id % 3 producer from (select page_id, {PATH_SQL} p from pages) where p like '%/%/%')"""


def produced(t: Tables) -> DataFrame:
    return owned(t).where("path <> owner").select("owner", "path", "page_id", (F.col("page_id") % 3).alias("producer"))


@query(f"""select o as "owner", list_sort(list(distinct producer)) producers, count(*) members from {PRODUCED} where p <> o group by 1""")
def directory_owner(t: Tables) -> DataFrame:
    return produced(t).groupBy("owner").agg(F.array_sort(F.collect_set("producer")).alias("producers"), F.count("*").alias("members"))


@query(f"""select o as "owner", min(producer) producer from {PRODUCED} where p <> o group by 1 having count(distinct producer) = 1""")
def atomic_bundles(t: Tables) -> DataFrame:
    b = produced(t).groupBy("owner").agg(F.min("producer").alias("producer"), F.count_distinct("producer").alias("n"))
    return b.where("n = 1").select("owner", "producer")


@query(f"""with b as (select o from {PRODUCED} where p <> o group by 1 having count(distinct producer) = 1) select distinct coalesce(b.o, x.p) root from {PRODUCED} x left join b on b.o = x.o where x.p <> x.o and x.page_id % 2 = 0""")
def collapse_bundles(t: Tables) -> DataFrame:
    b = atomic_bundles(t).select("owner", F.col("owner").alias("root"))
    return produced(t).where("page_id % 2 = 0").join(b, "owner", "left").select(F.coalesce("root", "path").alias("root")).distinct()


@query(f"""select page_id, bool_or(contains(o, '.com/')) covered from {PRODUCED} where p <> o group by 1""")
def retention_coverage(t: Tables) -> DataFrame:
    retained = produced(t).select("owner").distinct().where(F.col("owner").contains(".com/")).withColumn("kept", F.lit(True))
    return produced(t).join(retained, "owner", "left").groupBy("page_id").agg(F.max(F.coalesce("kept", F.lit(False))).alias("covered"))


VISITS = f"""v as materialized (select page_id, path, regexp_extract(path, '^[^/]*/[^/]*') dir, regexp_extract(path, '^[^/]*') host, 'crawler-' || (length(html) % 3) producer, url, length(html) n from (select page_id, url, html, {PATH_SQL} path from pages) s),
made as (select producer, page_id seq, dir path from v where contains(url, '?') union all select producer, page_id, host from v where contains(url, '#')),
c as (select page_id, page_id seq, dir, case when n % 5 = 0 then path || '.gz' else path end member from v where regexp_matches(url, '(/|html)$'))"""


@query(f"""with {VISITS}, o as (select distinct c.page_id, m.producer from c join made m on m.seq < c.seq and (m.path = c.dir or starts_with(c.dir, m.path || '/'))),
w as (select distinct c.page_id, x.producer from c join (select producer, page_id seq, path from v union all select * from made) x on x.seq < c.seq and starts_with(x.path, c.dir || '/')),
n as (select c.page_id, c.dir, c.member, (select count(*) from o where o.page_id = c.page_id) owners, (select min(producer) from o where o.page_id = c.page_id) one, (select count(*) from w where w.page_id = c.page_id and not exists (select 1 from o where o.page_id = w.page_id and o.producer = w.producer)) conflicts from c),
k as (select n.*, owners = 1 and not exists (select 1 from v where v.producer = n.one and v.path = n.member) missing from n)
select page_id consumer, dir directory, member, owners, conflicts, case when owners = 1 then one end as "owner", missing, case when owners = 0 then 'no_owner' when owners > 1 then 'several_owners' when conflicts > 0 then 'conflict' when missing then 'missing_member' else 'valid' end verdict from k""")
def directory_input_conflicts(t: Tables) -> DataFrame:
    """Pages as runs of three crawlers: each run writes its page, some a directory; some runs read a directory for one
    member, which one crawler alone must have made before."""
    path = url_path(F.col("url"))
    v = t("pages").select("page_id", "url", path.alias("path"), F.length("html").alias("n"))
    part = lambda pattern: F.regexp_extract("path", pattern, 0)
    v = v.select("*", part("^[^/]*/[^/]*").alias("directory"), part("^[^/]*").alias("host"), F.concat(F.lit("crawler-"), (F.col("n") % 3).cast("string")).alias("producer"), F.col("page_id").alias("seq"))
    made = lambda mark, where: v.where(F.col("url").contains(mark)).select("producer", "seq", F.col(where).alias("path"))
    member = F.when(F.col("n") % 5 == 0, F.concat("path", F.lit(".gz"))).otherwise(F.col("path"))
    readers = v.where(F.col("url").rlike("(/|html)$")).select(F.col("page_id").alias("consumer"), "seq", "directory", member.alias("member"))
    return directory_inputs(readers, v.select("producer", "seq", "path"), made("?", "directory").unionByName(made("#", "host")))


def repair_edges(t: Tables) -> DataFrame:
    """Errors that share a user's day, and errors with the user's error before within an hour: stars, not cliques."""
    e = t("events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    day = Window.partitionBy("user_id", F.to_date("ts"))
    shared = e.select(F.col("event_id").alias("src"), F.min("event_id").over(day).alias("dst"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cause = e.select(F.col("event_id").alias("src"), F.lag("event_id").over(w).alias("dst"), (F.col("ts") - F.lag("ts").over(w)).alias("gap")).where("gap <= interval 1 hour").select("src", "dst")
    return shared.unionByName(cause)


COMPONENTS = """with recursive e as (select event_id src, min(event_id) over (partition by user_id, ts::date) dst from events where event_type = 'error' union select event_id, p from (select event_id, ts, lag(event_id) over w p, lag(ts) over w q from events where event_type = 'error' window w as (partition by user_id order by ts, event_id)) where ts - q <= interval 1 hour),
b as (select src, dst from e union select dst, src from e), r(node, label) as (select src, src from b union select r.node, b.dst from r join b on b.src = r.label),
comp as (select node, min(label) label from r group by 1)"""


@query(f"""{COMPONENTS} select node, label from comp""")
def repair_components(t: Tables) -> DataFrame:
    return components(repair_edges(t))


@query(f"""{COMPONENTS}, s as (select label, count(*) n from comp group by 1) select c.node, case when s.n = 1 then 'user-bucket:' || (e.user_id % 10) else 'component:' || c.label end merged from comp c join s on s.label = c.label join events e on e.event_id = c.node""")
def merge_singletons(t: Tables) -> DataFrame:
    c = stored(components(repair_edges(t)), "components")
    n = c.groupBy("label").agg(F.count("*").alias("n"))
    users = t("events").select(F.col("event_id").alias("node"), "user_id")
    merged = F.when(F.col("n") == 1, F.concat(F.lit("user-bucket:"), (F.col("user_id") % 10).cast("string"))).otherwise(F.concat(F.lit("component:"), F.col("label").cast("string")))
    return c.join(n, "label").join(users, "node").select("node", merged.alias("merged"))


@query(f"""with c as {CHAIN} select n.event_id, case when n.event_type = 'error' and p.event_type = 'error' then 'blocked' when n.event_type = 'error' then 'failed' else 'passed' end outcome from events n left join c p on p.dst = n.event_id""")
def normalize_failed(t: Tables) -> DataFrame:
    before = sessions(t).select(F.col("next").alias("event_id"), F.col("event_type").alias("p"))
    j = t("events").select("event_id", "event_type").join(before, "event_id", "left")
    error = F.col("event_type") == "error"
    return j.select("event_id", F.when(error & (F.col("p") == "error"), "blocked").when(error, "failed").otherwise("passed").alias("outcome"))


@query(f"""with recursive c as (select * from {CHAIN} where dst is not null), r(root, node) as (select src, dst from c where event_type = 'error' union select root, c.dst from r join c on c.src = r.node) select node event_id, list_sort(list(distinct root)) roots from r group by 1""")
def root_blockers(t: Tables) -> DataFrame:
    w = day().rowsBetween(Window.unboundedPreceding, -1)
    e = t("events").select("event_id", F.array_sort(F.collect_list(F.when(is_error(), F.col("event_id"))).over(w)).alias("roots"))
    return e.where(F.size("roots") > 0)


def retries(t: Tables) -> DataFrame:
    """Events depend on their user's next event; an error sends its user back to the last purchase before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bought = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = t("events").select(F.col("event_id").alias("src"), F.lead("event_id").over(w).alias("next"), F.when(is_error(), bought).alias("back"))
    return e.select("src", F.explode(F.array("next", "back")).alias("dst")).where("dst is not null")


RETRIES = """(select event_id src, lead(event_id) over w dst from events window w as (partition by user_id order by ts, event_id)
union all select event_id, p from (select event_id, event_type, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) p from events) where event_type = 'error')"""


@query(f"""with recursive e as materialized (select src, dst from {RETRIES} where dst is not null), r(a, b) as (select src, dst from e union select r.a, e.dst from r join e on e.src = r.b)
select x.a node, min(x.b) "cycle" from r x join r y on y.a = x.b and y.b = x.a group by 1""")
def cycle_members(t: Tables) -> DataFrame:
    """Events on cycles, each with the least event of its strongly connected component."""
    return cycles(retries(t))


PLACED = f"""with recursive c as (select src, dst from {CHAIN} where dst is not null), s as (select event_id from events where event_type = 'error'), r(seed, node) as (select event_id, event_id from s union select seed, c.dst from r join c on c.src = r.node)"""


def blocked(t: Tables) -> DataFrame:
    """node, event_type and blockers of events with errors at or before them in their chain: chains are lines, so a
    running count says what a walk would."""
    n = F.count_if(is_error()).over(day().rowsBetween(Window.unboundedPreceding, 0))
    return t("events").select(F.col("event_id").alias("node"), "event_type", n.alias("blockers")).where("blockers > 0")


@query(f"""{PLACED} select node, count(distinct seed) blockers from r group by 1""")
def propagate_blockers(t: Tables) -> DataFrame:
    return blocked(t).select("node", "blockers")


@query(f"""{PLACED} select distinct node from r""")
def propagate_required(t: Tables) -> DataFrame:
    return blocked(t).select("node")


@query(f"""{PLACED} select distinct node from r where node not in (select event_id from s)""")
def blocked_closure(t: Tables) -> DataFrame:
    return blocked(t).where("not event_type <=> 'error'").select("node")


KINDS = ("region", "nation", "customer", "order", "ambiguity")


def numbered(kind: str, key: str) -> Column:
    """A node as one number, its key above its kind: a walk of many rounds joins numbers several times faster than names."""
    return F.shiftleft(F.col(key).cast("long"), 3) + KINDS.index(kind)


def numbered_keys(t: Tables) -> DataFrame:
    """The edges of foreign_keys between numbered nodes."""
    edge = lambda table, a, x, b, y: t(table).select(numbered(a, x).alias("src"), numbered(b, y).alias("dst"))
    a = edge("nation", "region", "n_regionkey", "nation", "n_nationkey")
    b = edge("customer", "nation", "c_nationkey", "customer", "c_custkey")
    return a.unionByName(b).unionByName(edge("orders", "customer", "o_custkey", "order", "o_orderkey"))


def disputes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders of one day and nearly one price, which can't be told apart: (ambiguity and node, numbered, for groups of two
    and more; node and name of these ambiguities). The least order's key stands for its ambiguity."""
    o = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.floor(F.col("o_totalprice") / 5000).cast("long").alias("price"))
    groups = o.groupBy("day", "price").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))
    several = stored(groups.where("n > 1 and day is not null and price is not null").select("day", "price", numbered("ambiguity", "least").alias("ambiguity")), "ambiguities")
    name = F.concat_ws(":", F.lit("ambiguity"), F.col("day").cast("string"), F.col("price").cast("string"))
    return o.join(several, ["day", "price"]).select("ambiguity", numbered("order", "o_orderkey").alias("node")), several.select(F.col("ambiguity").alias("node"), name.alias("name"))


OPERATIONAL = ("customer", "order")


@query(f"""with recursive e as materialized (select src, dst from {FK_SQL} union all select dst, src from {FK_SQL}),
m as (select 'ambiguity:' || cast(o_orderdate::date as varchar) || ':' || cast(floor(o_totalprice / 5000) as bigint) a, 'order:' || o_orderkey node from orders),
l as materialized (select a, node from m where a in (select a from m group by a having count(*) > 1)),
links as materialized (select src, dst from e where split_part(src, ':', 1) in ('customer', 'order') union all select node, a from l union all select a, node from l),
seeds as (select 'customer:' || c_custkey node from customer where c_acctbal > 9900),
r(node) as (select node from seeds union select dst from e join seeds on src = node union select dst from r join links on src = node)
select node, split_part(node, ':', 1) kind from r""")
def typed_neighbourhood(t: Tables) -> DataFrame:
    """What belongs to rich customers: one hop by any edge, further hops from customers and orders alone, and whatever an
    ambiguity of a node found holds beside it."""
    among, names = disputes(t)
    code = lambda c: F.col(c).bitwiseAND(7)
    seeds = t("customer").where("c_acctbal > 9900").select(numbered("customer", "c_custkey").alias("node"))
    found = neighbourhood(seeds, numbered_keys(t), among, code("src").isin(*(KINDS.index(k) for k in OPERATIONAL))).select("node")
    ambiguous = code("node").eqNullSafe(KINDS.index("ambiguity"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (code("node") + 1).cast("int"))
    named = found.where(~ambiguous).select(F.concat(kind, F.lit(":"), F.shiftright("node", 3).cast("string")).alias("node"), kind.alias("kind"))
    return named.unionByName(found.where(ambiguous).join(names, "node").select(F.col("name").alias("node"), F.lit("ambiguity").alias("kind")))


@query(f"""select node from (select 'nation:' || n_nationkey node from nation where n_regionkey = 1 union all select 'region:1') where node in (select src from {FK_SQL} where dst like 'customer:%' and cast(split_part(dst, ':', 2) as integer) % 100 = 7) or node = 'region:1'""")
def path_ambiguities(t: Tables) -> DataFrame:
    e = stored(foreign_keys(t).where(F.col("dst").rlike("^(nation|customer):")), "edges")
    forward = reach(t("region").where("r_regionkey = 1").select(F.lit("region:1").alias("node")), e)
    targets = t("customer").where("c_custkey % 100 = 7").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"))
    backward = reach(targets, e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return forward.select("node").intersect(backward.select("node")).where(~F.col("node").startswith("customer:"))


@query("""select 'customer:' || c_custkey target, 'region:' || n_regionkey holder from customer join nation on n_nationkey = c_nationkey""")
def holders_of_target(t: Tables) -> DataFrame:
    """Regions above customers."""
    e = foreign_keys(t).where(F.col("dst").rlike("^(nation|customer):"))
    name = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))
    up = reach(t("customer").select(name.alias("target"), name.alias("node")), e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ("target",))
    return up.where(F.col("node").startswith("region:")).select("target", F.col("node").alias("holder"))


@query(f"""with recursive c as (select src, dst from {CHAIN} where dst is not null), r(start, node, depth) as (select event_id, event_id, 0 from events where event_type = 'purchase' union select start, c.src, depth + 1 from r join c on c.dst = r.node),
k as (select start, node, depth, row_number() over (partition by start order by depth, node) q from r join events e on e.event_id = r.node and e.event_type = 'error') select start event_id, node cause, depth from k where q = 1""")
def primary_cause(t: Tables) -> DataFrame:
    e = t("events").select("event_id", "event_type", "user_id", "ts", F.row_number().over(day()).alias("place"))
    last = F.last(F.when(is_error(), F.struct("event_id", "place")), ignorenulls=True).over(day().rowsBetween(Window.unboundedPreceding, 0))
    found = e.select("event_id", "event_type", "place", last.alias("m")).where("event_type = 'purchase' and m is not null")
    return found.select("event_id", F.col("m.event_id").alias("cause"), (F.col("place") - F.col("m.place")).alias("depth"))
