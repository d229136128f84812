"""Queries over traces and sinks (ST1 to ST7, SK1 to SK6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import compare
from ..operators.order import running
from ..registry import Tables, query
from ..sources import sinks
from ..storage import shared_path
from ..streaming import traces
from .joins import PERTURBED

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
SUMMARY = """select user_id, count(*) events, count(*) filter (event_type = 'error') errors, count(*) filter (not json_valid(props)) invalid, sum(round(value * 100)::bigint)::bigint cents from events group by 1"""


@query(SUMMARY)
def stream_event_summary(t: Tables) -> DataFrame:
    return traces.drained(t.spark, t.sf_dir, EVENTS, traces.event_summary, "update", "events.parquet")


@query(SUMMARY)
def event_summary(t: Tables) -> DataFrame:
    return traces.event_summary(t("events"))


@query("""select user_id, "day", case when s = 0 then 'no_start' when p = 0 then 'no_usage' end violation from (select user_id, cast(ts::date as varchar) "day", count(*) filter (event_type = 'signup') s, count(*) filter (event_type = 'purchase') p from events group by 1, 2) where s = 0 or p = 0""")
def stream_contract(t: Tables) -> DataFrame:
    """User-days that begin without a signup, or end without a purchase."""
    n = t("events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count_if(F.col("event_type") == "signup").alias("s"), F.count_if(F.col("event_type") == "purchase").alias("p"))
    return n.select("user_id", "day", F.when(F.col("s") == 0, "no_start").when(F.col("p") == 0, "no_usage").alias("violation")).where("violation is not null")


@query("""select user_id, max(value) peak, arg_max(event_type, event_id) last_type, max(value) / nullif(arg_max(value, event_id), 0) ratio from events group by 1""")
def session_trace(t: Tables) -> DataFrame:
    peak, last = F.max("value"), F.max_by("value", "event_id")
    return t("events").groupBy("user_id").agg(peak.alias("peak"), F.max_by("event_type", "event_id").alias("last_type"), F.try_divide(peak, last).alias("ratio"))


@query("""select event_id, row_number() over (partition by user_id order by event_id) k from events where event_type = 'error'""")
def stream_new_boundary(t: Tables) -> DataFrame:
    return traces.boundaries(t.spark, t.sf_dir, EVENTS, "events.parquet")


@query("""select 'store' sink, 'complete' status, count(*) n from events union all select 'errors', 'complete', count(*) from events where event_type = 'error' union all select 'broken', 'failed: "no space"', 0""")
def stream_tee(t: Tables) -> DataFrame:
    """A stream of the events to a required sink, an optional one, and one that fails; the stream then runs once more."""
    kept, other, state = (shared_path(t.spark, x) for x in ("tee", "tee", "tee-state"))

    def broken(batch: DataFrame, number: int) -> None:
        raise OSError("no space")

    sinks = {"store": (traces.by_batch(kept), True), "errors": (traces.by_batch(other, F.col("event_type") == "error"), False), "broken": (broken, False)}
    for _ in range(2):
        stream = t.spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
        status = traces.tee(stream, sinks, state)
    rows = [t.spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(k).alias("sink"), F.lit(status[k]).alias("status"), "n") for k, p in (("store", kept), ("errors", other))]
    return rows[0].unionByName(rows[1]).unionByName(rows[0].select(F.lit("broken").alias("sink"), F.lit(status["broken"]).alias("status"), F.lit(0).cast("long").alias("n")))


@query("""with c as (select conv_id, count(*) turns, sum(strlen(text))::bigint bytes from conversations group by 1), f as (select conv_id, min(turn) flip from (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) p from conversations) where role = 'user' and p = 'assistant' group by 1) select conv_id, turns, bytes, flip from c left join f using (conv_id)""")
def trial_summary(t: Tables) -> DataFrame:
    c = t("conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    flip = c.withColumn("p", F.lag("role").over(w)).where("role = 'user' and p = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("flip"))
    sums = c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.octet_length("text")).alias("bytes"))
    return sums.join(flip, "conv_id", "left")


@query("""select o_orderstatus slot, case when o_orderstatus = 'P' then 2 else 1 end "generation", count(*) n from orders group by 1, 2""")
def publish_slot(t: Tables) -> DataFrame:
    """All slots are published, then one again: it alone is replaced."""
    path = shared_path(t.spark, "slots")
    rows = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("slot"))
    sinks.publish_slots(rows.withColumn("generation", F.lit(1)), path)
    sinks.publish_slots(rows.where("slot = 'P'").withColumn("generation", F.lit(2)), path)
    return t.spark.read.parquet(path).groupBy(F.col("slot").cast("string").alias("slot"), "generation").agg(F.count("*").alias("n"))


@query(f"""select 'appended' outcome, count(*) n from orders where o_orderkey % 101 = 0 union all select 'conflict', count(*) from orders a join {PERTURBED} b using (o_orderkey) where a.o_totalprice <> b.o_totalprice union all select 'kept', count(*) from orders a join {PERTURBED} b using (o_orderkey) where a.o_totalprice = b.o_totalprice""")
def append_idempotent(t: Tables) -> DataFrame:
    digest = lambda df: df.select("o_orderkey", F.sha2(F.col("o_totalprice").cast("string"), 256).alias("digest"))
    return sinks.append_plan(digest(compare.perturbed(t("orders"))), digest(t("orders")), ["o_orderkey"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""select user_id, event_type, max(event_id) event_id from events where not (user_id % 10 = 0 and event_id % 2 = 1) group by 1, 2""")
def upsert_latest(t: Tables) -> DataFrame:
    e = t("events").select("user_id", "event_type", "event_id")
    stale = e.where("user_id % 10 = 0 and event_id % 2 = 1")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    pointers = lambda df: df.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return sinks.upsert_latest(pointers(old), pointers(new.join(stale, "event_id", "left_anti")), stale.select("event_id"), ["user_id", "event_type"], "event_id")


@query("""select p_brand, p_partkey, bytes from (select p_brand, p_partkey, sum(strlen('{"name":"' || p_name || '","partkey":' || p_partkey || '}') + 1) over (partition by p_brand order by p_partkey)::bigint bytes from part) where bytes <= 1024""")
def capped_json_rows(t: Tables) -> DataFrame:
    """Parts as JSON rows, each brand's as far as its rows stay within the limit."""
    line = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_partkey").alias("partkey")))
    rows = t("part").select("p_brand", "p_partkey", (F.octet_length(line) + 1).cast("long").alias("size"))
    return running(rows, ["p_brand"], [F.col("p_partkey")], F.col("size"), "bytes").where("bytes <= 1024").select("p_brand", "p_partkey", "bytes")


@query("""select '| ' || coalesce(r_name, 'total') || ' | ' || n || ' |' line from (select r_name, count(*) n from region join nation on n_regionkey = r_regionkey group by rollup (r_name))""")
def report_rows(t: Tables) -> DataFrame:
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).rollup("r_name").agg(F.count("*").alias("n"))
    cell = F.regexp_replace(F.coalesce("r_name", F.lit("total")), r"\|", r"\\\\|")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", cell, F.col("n").cast("string")), F.lit(" |")).alias("line"))


@query("""select o_orderkey, o_orderkey % 5 stored, coalesce(n, 0) actual from orders left join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey where o_orderkey % 5 <> coalesce(n, 0)""")
def audit_counts(t: Tables) -> DataFrame:
    actual = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    j = t("orders").join(actual, "o_orderkey", "left").select("o_orderkey", (F.col("o_orderkey") % 5).alias("stored"), F.coalesce("n", F.lit(0)).alias("actual"))
    return j.where("stored <> actual")
