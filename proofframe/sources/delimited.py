"""Rows of delimited files at their positions: over several files and splits, without one task that reads them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.order import running
from ..storage import stored


def cells(line: Column, sep: str = ",") -> Column:
    """The cells of a delimited line as text; null where quotes are out of place. A cell is quoted as a whole or not at
    all; a doubled quote in a quoted one is a quote."""
    raw = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'\\Q{sep}\\E("(?:[^"]|"")*"|[^"\\Q{sep}\\E]*)'), F.lit(1))
    whole = F.array_join(raw, sep) == line
    bare = lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.when(whole, F.transform(raw, bare))


def positioned(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """position (from 1 over all files, in order of their names), file, row (from 1 in its file), line and cells of every
    line of the delimited files of a folder. cells is null where the line is malformed; a quoted line break is none.

    Lines of a split keep their order; the splits' sizes are summed up in order of file and offset."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"))
    lines = stored(lines.withColumn("at", F.monotonically_increasing_id()), "lines")
    splits = lines.groupBy("file", "offset").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    splits = splits.withColumn("in_file", F.sum("n").over(Window.partitionBy("file").orderBy("offset")))
    splits = stored(running(splits, [], [F.col("file"), F.col("offset")], F.col("n"), "in_all"), "splits")
    place = F.col("at") - F.col("first") + 1
    rows = lines.join(splits, ["file", "offset"])
    return rows.select((F.col("in_all") - F.col("n") + place).alias("position"), "file", (F.col("in_file") - F.col("n") + place).alias("row"), F.col("value").alias("line"), cells(F.col("value"), sep).alias("cells"))
