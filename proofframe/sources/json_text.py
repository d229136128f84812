"""JSON texts with exact types: differences of two, reasons for refusal, strings of any depth.

Python's decoder reads them, many a batch: VARIANT drops the sign of a zero, ends at 38 digits, and says of a text with a
repeated key or a NaN no more than that it isn't JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = 256  # characters of a value that a difference shows


class Refused(ValueError):
    pass


def unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Refused("duplicate_key")
    return out


def non_finite(name: str) -> object:
    raise Refused("non_finite")


def decoded(text: str | None) -> tuple[object, str | None]:
    """(value, None), or (None, reason): missing, byte_order_mark, duplicate_key, non_finite, too_deep or malformed."""
    if text is None:
        return None, "missing"
    if text.startswith("﻿"):
        return None, "byte_order_mark"
    try:
        return json.loads(text, object_pairs_hook=unique, parse_constant=non_finite, parse_float=finite), None
    except Refused as e:
        return None, str(e)
    except RecursionError:
        return None, "too_deep"
    except ValueError:
        return None, "malformed"


def finite(text: str) -> float:
    if math.isinf(x := float(text)):
        raise Refused("non_finite")
    return x


def shown(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)[:SHOWN]


def differences(a: object, b: object) -> Iterator[tuple[str, str, str]]:
    """(path, expected, found) of what differs between two values: type, keys, length or value. What is below unlike keys
    or lengths isn't compared; the order of keys is no difference; 1 is unlike 1.0, true and "1", 0.0 unlike -0.0."""
    todo = [(a, b, "$")]
    while todo:
        x, y, path = todo.pop()
        if type(x) is not type(y):
            yield path, shown(x), shown(y)
        elif isinstance(x, dict):
            if x.keys() == y.keys():
                todo += [(x[k], y[k], f"{path}[{json.dumps(k, ensure_ascii=False)}]") for k in x]
            else:
                yield f"{path} keys", shown(sorted(x)), shown(sorted(y))
        elif isinstance(x, list):
            if len(x) == len(y):
                todo += [(v, w, f"{path}[{i}]") for i, (v, w) in enumerate(zip(x, y, strict=True))]
            else:
                yield f"{path} length", str(len(x)), str(len(y))
        elif x != y or (isinstance(x, float) and math.copysign(1, x) != math.copysign(1, y)):
            yield path, shown(x), shown(y)


def strings(text: str | None) -> list[str] | None:
    """All strings of a JSON text in their order, keys left out; the text itself where it isn't JSON."""
    if text is None:
        return None
    try:
        todo, out = [json.loads(text)], []
    except (ValueError, RecursionError):
        return [text]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, (list, dict)):
            todo += reversed(x if isinstance(x, list) else list(x.values()))
    return out


def mapped(df: DataFrame, keep: Sequence[str], inputs: Sequence[str], make: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """keep and the columns of schema: a row for each tuple of make(values of inputs)."""
    rows = df.select(*keep, *(F.col(c).alias(f"input_{i}") for i, c in enumerate(inputs)))
    names = [x.split()[0] for x in schema.split(", ")]
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(*values) for values in zip(*(batch.column(at + i).to_pylist() for i in range(len(inputs))), strict=True)]
            owner = pa.array([i for i, m in enumerate(made) for _ in m], pa.int64())
            flat = [x for m in made for x in m]
            columns = [pa.array([x[i] for x in flat]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(owner) for i in range(at)), *columns], names=[*keep, *names])

    kept = [f"`{c}` {kind}" for c, kind in rows.select(*keep).dtypes]
    return rows.mapInArrow(run, ", ".join([*kept, schema]))


def json_differences(df: DataFrame, expected: str, found: str, *keep: str) -> DataFrame:
    """keep, path, expected and found of all differences of two columns of JSON text. A text that is refused is a
    difference at $, with the reason in place of the value, unless both sides are the same text."""

    def make(x: str | None, y: str | None) -> list[tuple]:
        if x == y:
            return []
        (a, why_a), (b, why_b) = decoded(x), decoded(y)
        if why_a or why_b:
            return [("$", why_a or shown(a), why_b or shown(b))]
        return list(differences(a, b))

    return mapped(df, keep, [expected, found], make, "path string, expected string, found string")


def json_reasons(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep and reason: why a JSON text is refused, null where it isn't."""
    return mapped(df, keep, [text], lambda x: [(decoded(x)[1],)], "reason string")


def json_strings(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep and strings of a column of JSON text."""
    return mapped(df, keep, [text], lambda x: [(strings(x),)], "strings array<string>")
