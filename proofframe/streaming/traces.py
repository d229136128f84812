"""Event traces folded by Structured Streaming; each has a batch twin with the same result."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import exists, removed, shared_path


def event_summary(events: DataFrame) -> DataFrame:
    """user_id with counts of events, errors and invalid properties, and the sum of values in hundredths; works on a
    stream (update or complete mode) and on a table alike."""
    cents = F.round(F.col("value") * 100).cast("long")
    return events.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.try_parse_json("props").isNull()).alias("invalid"), F.sum(cents).alias("cents"))


PARTS = 64  # of the users' counters; a batch rewrites those that it touches


def boundaries(spark: SparkSession, source: str, schema: str, pattern: str = "*", files_per_batch: int | None = None, folder: str | None = None) -> DataFrame:
    """event_id of each event at which its user's error count grew, with that count k, each emitted once, after all that
    is in the folder source has run through a stream. With a folder of the caller's a later call goes on from there with
    what has come since; without one it begins anew.

    The counters of users are a table in PARTS parts by a hash of the user. A batch takes its numbers from the parts as the
    batch before left them, writes the parts that it touches under its own number, and then a list of which batch wrote
    each part last. So a batch that is run again writes over what it wrote, and parts that neither this list nor the one
    before names are deleted. Within a batch events count in order of event_id, and batches in order of arrival. No counter
    is ever dropped. Rows of a batch are numbered by a window over its user's errors in JVM operators alone."""
    folder = folder or shared_path(spark, "boundaries")
    counters = "user_id long, n long"

    def listed(s: SparkSession, number: int) -> dict[int, int]:
        """part to the batch that wrote it last: at most PARTS rows."""
        if number < 0:
            return {}
        return {r["part"]: r["batch"] for r in s.read.schema("part int, batch long").parquet(f"{folder}/lists/{number}").collect()}

    def count(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        part = F.pmod(F.xxhash64("user_id"), F.lit(PARTS)).cast("int")
        errors = batch.where("event_type = 'error'").select("user_id", "event_id")
        own = errors.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("part", part)
        touched = [r["part"] for r in own.select("part").distinct().collect()]  # PARTS at most
        known = listed(s, number - 1)
        paths = [f"{folder}/counters/{known[p]}/part={p}" for p in touched if p in known]
        before = s.read.schema(counters).parquet(*paths) if paths else s.createDataFrame([], counters)
        place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
        numbered = errors.withColumn("own", place).join(before, "user_id", "left")
        numbered.select("event_id", (F.col("own") + F.coalesce("n", F.lit(0))).cast("long").alias("k")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        after = before.unionByName(own.select("user_id", "n")).groupBy("user_id").agg(F.sum("n").alias("n"))
        after.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/counters/{number}")
        now = known | dict.fromkeys(touched, number)
        s.createDataFrame(sorted(now.items()), "part int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/lists/{number}")
        for p, b in listed(s, number - 2).items():
            if b not in (known.get(p), now[p]):
                removed(s, f"{folder}/counters/{b}/part={p}")
        removed(s, f"{folder}/lists/{number - 3}")

    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = reader.parquet(source).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    writer.foreachBatch(count).start().awaitTermination()
    return spark.read.schema("event_id long, k long, batch int").parquet(f"{folder}/out").select("event_id", "k")


def drained(spark: SparkSession, source: str, schema: str, build: Callable[[DataFrame], DataFrame], mode: str = "append", pattern: str = "*", files_per_batch: int | None = None) -> DataFrame:
    """What a stream over the Parquet files of a folder gives, once all that is there has run through; in update mode
    of rows of one user_id the last."""
    out = shared_path(spark, "stream-out")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = build(reader.parquet(source)).writeStream.trigger(availableNow=True).option("checkpointLocation", shared_path(spark, "stream-state"))
        if mode == "append":
            writer.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
        else:
            writer.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    rows = spark.read.parquet(out)
    if mode == "update":
        last = F.max_by(F.struct(*(c for c in rows.columns if c != "batch")), "batch")
        rows = rows.groupBy("user_id").agg(last.alias("r")).select("r.*")
    return rows


class Overdue(TimeoutError):
    """The one deadline of all sinks has passed."""


def tee(df: DataFrame, sinks: dict[str, tuple[Callable[[DataFrame, int], None], bool]], state: str, timeout: float = 300) -> dict[str, str]:
    """One stream to several sinks. A sink is (write(batch, number), required): an optional one that fails is left out
    from then on and the others go on; a required one's failure ends the stream and is raised. Gives each sink's state.

    A ledger beside the stream's state has a row for each sink and batch that is done, and for each optional sink that has
    failed, so a batch that runs again, after a restart too, goes to those sinks alone that lack it. Where a run dies
    between a sink's write and its row, the sink sees the same batch and number again: `by_batch` writes over what it
    wrote. The deadline holds for all sinks together: once it has passed no sink is begun and the stream ends with Overdue."""
    spark, ledger, schema = df.sparkSession, f"{state}/ledger", "sink string, batch long, failure string"
    end = time.monotonic() + timeout
    rows = spark.read.schema(schema).parquet(ledger).collect() if exists(spark, ledger) else []
    done = {(r["sink"], r["batch"]) for r in rows if r["failure"] is None}
    status = dict.fromkeys(sinks, "complete") | {r["sink"]: r["failure"] for r in rows if r["failure"] is not None and r["sink"] in sinks}

    def enter(batch: DataFrame, name: str, number: int, failure: str | None) -> None:
        batch.sparkSession.range(1).select(F.lit(name).alias("sink"), F.lit(number).cast("long").alias("batch"), F.lit(failure).cast("string").alias("failure")).write.mode("append").parquet(ledger)

    def write(batch: DataFrame, number: int) -> None:
        todo = [n for n in sinks if status[n] == "complete" and (n, number) not in done]
        if not todo:
            return
        batch.persist()
        try:
            for name in todo:
                sink, required = sinks[name]
                try:
                    if time.monotonic() > end:
                        raise Overdue(f"no time is left for {name}")
                    sink(batch, number)
                except Exception as e:  # a sink is foreign code
                    if required or isinstance(e, Overdue):
                        raise
                    status[name] = f"failed: {json.dumps(str(e)[:200])}"
                    enter(batch, name, number, status[name])
                else:
                    enter(batch, name, number, None)
                    done.add((name, number))
        finally:
            batch.unpersist()

    q = df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{state}/stream").foreachBatch(write).start()
    try:
        if not q.awaitTermination(max(0.001, end - time.monotonic())):
            raise Overdue("the stream did not end in time")
    finally:
        if q.isActive:
            q.stop()
    return status


def by_batch(path: str, condition: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A sink of Parquet files below path, a folder for each batch: a batch that comes again takes the place of its first
    writing."""

    def sink(batch: DataFrame, number: int) -> None:
        (batch if condition is None else batch.where(condition)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink
