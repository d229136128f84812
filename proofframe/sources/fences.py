"""Fenced blocks of Markdown texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPENS = re.compile(r"\s*(`{3,}|~{3,})")
ROWS = 50_000  # lines sent on at a time


def fenced(lines: list[str]) -> list[bool]:
    """Whether each line is in a fenced block, its fences included: three or more of one character open it, and a line of
    as many or more of the same, and white space only, closes it; what nothing closes goes to the end."""
    out, fence = [], ""
    for line in lines:
        if not fence:
            found = OPENS.match(line)
            fence = found[1] if found else ""
            out.append(bool(found))
            continue
        out.append(True)
        mark = line.strip()
        if len(mark) >= len(fence) and mark == fence[0] * len(mark):
            fence = ""
    return out


def fenced_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, line_no (from 1) and inside of every line of a text column. A text is one row and is read once, in order;
    null texts have no lines, empty ones have one."""
    rows = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("text_"))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column(at).to_pylist()):
                inside = fenced(content.split("\n"))
                own = batch.slice(i, 1)
                for a in range(0, len(inside), ROWS):
                    b = min(a + ROWS, len(inside))
                    zeros = pa.array([0] * (b - a), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(own.column(c).take(zeros) for c in range(at)), pa.array(range(a + 1, b + 1), pa.int64()), pa.array(inside[a:b], pa.bool_())], names=[*keep, "line_no", "inside"])

    kept = [f"`{c}` {kind}" for c, kind in rows.select(*keep).dtypes]
    return rows.mapInArrow(run, ", ".join([*kept, "line_no long", "inside boolean"]))
