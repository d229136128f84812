"""Scans of files and of text that holds structure."""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of delimited files with a header; all cells stay text, ragged rows are rejects.

    Raises ValueError where the header isn't the unique columns asked for."""
    if len(set(columns)) != len(columns):
        raise ValueError("repeated column")
    head = spark.read.option("sep", sep).csv(path).first()
    if head is not None and [*head] != columns:
        raise ValueError(f"header is {[*head]}")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("_corrupt", T.StringType())])
    df = spark.read.schema(schema).option("sep", sep).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", False).csv(path)
    return df.where("_corrupt is null").drop("_corrupt"), df.where("_corrupt is not null")


def json_field(text: Column, path: str, kind: str) -> Column:
    """A typed field of JSON text; null where the text isn't JSON or the field isn't of that type."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep with line_no (from 1) and line of a text column."""
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(*keep, (F.col("pos") + 1).alias("line_no"), "line")


def glob_regex(pattern: str) -> str:
    """A regular expression for a pattern whose last segment may hold * ? and [...]; * and ? stop at a slash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 1)) > 0:
            out += pattern[i : end + 1].replace("[!", "[^")
            i = end
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r".\+^$(){}|]" else c)
        i += 1
    return f"^{out}$"


def front_matter(text: Column) -> Column:
    """Keys and values of a leading block between --- lines, as a map; null without one."""
    block = F.regexp_extract(text, r"^---\n((?:[^\n]*\n)*?)---(?:\n|$)", 1)
    return F.when(block != "", F.str_to_map(F.regexp_replace(block, "\n$", ""), F.lit("\n"), F.lit(": ")))


def markdown_cells(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep with row_no, col_no (from 0, without the rule line) and cell of a Markdown table; \\| is a bar in a cell."""
    rows = lines(df, text, *keep).where(~F.col("line").rlike(r"^\|[\s:|-]+\|$")).where(F.col("line").startswith("|"))
    row = F.row_number().over(_by(keep)) - 1
    body = F.regexp_extract("line", r"^\|(.*)\|\s*$", 1)
    cells = rows.withColumn("row_no", row).select(*keep, "row_no", F.posexplode(F.split(body, r"(?<!\\)\|")).alias("col_no", "raw"))
    return cells.select(*keep, "row_no", "col_no", F.regexp_replace(F.trim("raw"), r"\\\|", "|").alias("cell"))


def _by(keep: tuple[str, ...]):
    from pyspark.sql.window import Window

    return Window.partitionBy(*keep).orderBy("line_no")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, size and time of every file below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), "modificationTime")


# What files of a kind begin with, and the suffixes of kinds that begin with anything.
HDF5_MAGIC = "894844460D0A1A0A"
ZIP_MAGIC = ("504B0304", "504B0506", "504B0708")
SUFFIXES = {".json": "json", ".csv": "csv", ".tsv": "tsv", ".log": "text", ".txt": "text"}
UNSAFE_SUFFIXES = (".pkl", ".pickle")
MAGIC_BYTES = 8


def classified(path: Column, head: Column, declared: Column) -> Column:
    """Struct of observed and problem of a file by its first bytes and suffix: HDF5 by its magic bytes whatever the
    suffix, NPZ by a ZIP's and its suffix, the others by suffix alone. problem: unsafe (a suffix of formats that run code),
    unsupported, or mismatch (declared isn't observed); null declared says nothing."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))
    first = F.hex(F.substring(head, 1, MAGIC_BYTES))
    zipped = first.startswith(ZIP_MAGIC[0]) | first.startswith(ZIP_MAGIC[1]) | first.startswith(ZIP_MAGIC[2])
    kinds = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    observed = F.when(first.startswith(HDF5_MAGIC), "hdf5").when(zipped & (suffix == ".npz"), "npz").otherwise(kinds[suffix])
    problem = F.when(observed.isNull() & suffix.isin(*UNSAFE_SUFFIXES), "unsafe").when(observed.isNull(), "unsupported").when(declared != observed, "mismatch")
    return F.struct(observed.alias("observed"), problem.alias("problem"))


def classified_files(spark: SparkSession, path: str, declared: Column | None = None) -> DataFrame:
    """path, observed and problem of every file below a folder that isn't empty (Spark's file scans leave empty ones out)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    said = F.lit(None).cast("string") if declared is None else declared
    return found.select("path", classified(F.col("path"), F.col("content"), said).alias("c")).select("path", "c.*")


def npz_members(files: DataFrame) -> DataFrame:
    """file, member, dtype, shape, and values of NPZ files (path, content), one row for a member, in name order.

    Members of objects are refused: error says so, values are null."""

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for name in sorted(z.files):
                        try:
                            v = z[name]
                            out.append((path, name, str(v.dtype), list(v.shape), v.ravel().astype(float).tolist(), None))
                        except ValueError as e:
                            out.append((path, name, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["file", "member", "dtype", "shape", "values", "error"])

    return files.select("path", "content").mapInPandas(run, "file string, member string, dtype string, shape array<long>, values array<double>, error string")


def tail(text: Column, n: int) -> Column:
    """The last n characters with control characters as spaces, and whether something was cut."""
    return F.struct(F.regexp_replace(F.right(text, F.lit(n)), r"[\x00-\x1F\x7F]", " ").alias("tail"), (F.length(text) > n).alias("cut"))
