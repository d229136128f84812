"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Up to so many edges (16 bytes each) are joined up by one task.
TASK_EDGES = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node in edges (src and dst, of one type: long or string).
    Edges with a null end are left out; a node with an edge to itself alone is its own component.

    Large-star and small-star steps take turns (Kiveris et al. 2014): every node hands its neighbours to the smallest one,
    so paths halve and the edges never grow beyond their number. Each round is written to the shared folder. Edge tables of
    at most TASK_EDGES rows are labelled by one task instead, which takes the place of many small jobs.
    """
    given = stored(edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).where("x is not null and y is not null").distinct(), "edges")
    own = given.where("x = y").select(F.col("x").alias("node"), F.col("y").alias("label"))
    at = given.where("x <> y")
    label = None
    before = None
    for _ in count():
        if at.count() <= TASK_EDGES:
            kind = dict(at.dtypes)["x"]
            label = at.coalesce(1).mapInArrow(labelled, f"node {kind}, label {kind}")
            break
        both = at.unionByName(at.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.where("x <> y").distinct()
        down = large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        low = down.groupBy("x").agg(F.min("y").alias("m"))
        pair = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
        small = down.join(low, "x").select(F.explode(F.array(pair("x", "m"), pair("y", "m"))).alias("e")).select("e.x", "e.y")
        at = stored(small.where("x <> y").distinct(), "edges")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            label = at.select(F.col("x").alias("node"), F.col("y").alias("label"))
            label = label.unionByName(at.select(F.col("y").alias("node"), F.col("y").alias("label")))
            break
        before = now
    return label.unionByName(own).groupBy("node").agg(F.min("label").alias("label"))


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and label of the edges (x, y) in all batches."""
    batches = list(batches)
    kind = batches[0].schema.field(0).type if batches else pa.int64()
    empty = np.zeros(0, object if pa.types.is_string(kind) else np.int64)
    x, y = (np.concatenate([empty, *(b.column(c).to_numpy(zero_copy_only=False) for b in batches)]) for c in range(2))
    nodes, number = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = number[: len(x)], number[len(x) :]
    root = np.arange(len(nodes))
    while True:  # hook the larger root below the smaller, then let every node jump to its root
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(nodes[root], kind)], names=["node", "label"])
