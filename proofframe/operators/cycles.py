"""Nodes on cycles of a directed graph: its strongly connected components, without a limit of depth.

Rounds of trimming drop nodes without an edge in or out. A node with one edge in is merged into the node it comes from, one
with one edge out into the node it goes to: others reach one another as before, and the merged node lies on a cycle just
when its partner lies on one with a further neighbour of it. Coins decide who is merged in a round, so chains, rings and
trees of any length take rounds by their logarithm. What is left goes to one task once it is small. Larger, every node takes
the greatest node that reaches it as its colour, doubling the way at each step; from the nodes that kept their own colour
the walk back inside the colour finds one component each; edges between colours lie on no cycle, and the rest begins anew.

Joins of a round are marked as merge joins: tables shrink from round to round, and Spark would collect each that has become
small enough for a broadcast at the driver, again and again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .components import TASK_EDGES
from .fixpoint import reach


def contracted(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """One round: (edges left, for each merged node its partner p and what its further neighbours q are now, nodes that
    cycles shrank to, whether anything went or could go)."""
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("src").alias("u"))
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("w"))
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 1
    partner = F.when(F.col("n_in") == 1, F.col("u")).when(F.col("n_out") == 1, F.col("w"))
    both = ins.join(outs.hint("merge"), "node").select("node", (F.col("n_in") == 1).alias("from_u"), partner.alias("p"))
    able = F.col("p").isNotNull()
    nodes = stored(both.select("node", "from_u", able.alias("able"), F.when(coin("node") & ~coin("p"), F.col("p")).alias("p")), "nodes")
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("p").alias(f"{c}_p"), F.col("from_u").alias(f"{c}_from"))
    named = edges.join(end("src").hint("merge"), "src").join(end("dst").hint("merge"), "dst")
    merging = (F.col("dst_from") & F.col("dst_p").eqNullSafe(F.col("src"))) | (~F.col("src_from") & F.col("src_p").eqNullSafe(F.col("dst")))
    named = stored(named.where(~merging).select("*", F.coalesce("src_p", "src").alias("x"), F.coalesce("dst_p", "dst").alias("y")), "named")
    further = named.where("src_p is not null and src_from").select(F.col("src").alias("node"), F.col("src_p").alias("p"), F.col("y").alias("q"))
    further = further.union(named.where("dst_p is not null and not dst_from").select("dst", "dst_p", "x"))
    left = stored(named.where("x <> y").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct(), "edges")
    moved = nodes.where("able").limit(1).count() > 0 or named.count() < edges.count()
    return left, further, named.where("x = y").select(F.col("x").alias("node")).distinct(), moved


def coloured(edges: DataFrame) -> DataFrame:
    """node and colour, the greatest node that reaches it."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colours = stored(ends.select("node", F.col("node").alias("colour")), "colours")
    while True:
        sent = edges.join(colours.hint("merge"), edges["src"] == colours["node"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("sent"))
        step = colours.join(sent.hint("merge"), "node", "left").select("node", F.col("colour").alias("old"), F.greatest("colour", F.coalesce("sent", "colour")).alias("colour"))
        ahead = colours.select(F.col("node").alias("colour"), F.col("colour").alias("ahead"))  # who reaches my colour reaches me
        new = stored(step.join(ahead.hint("merge"), "colour", "left").select("node", "old", F.greatest("colour", F.coalesce("ahead", "colour")).alias("colour")), "colours")
        if new.where("old <> colour").isEmpty():
            return new.select("node", "colour")
        colours = new.select("node", "colour")


def core_components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node and label of the components of two nodes and more that one colouring finds, the edges left)."""
    colours = coloured(edges)
    name = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
    inside = edges.join(name("src").hint("merge"), "src").join(name("dst").hint("merge"), "dst").where("src_colour = dst_colour")
    inside = stored(inside.select("src", "dst"), "edges")
    back = reach(colours.where("node = colour").select("node"), inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = stored(back.select("node").join(colours.hint("merge"), "node").select("node", F.col("colour").alias("label")), "found")
    rest = inside
    for c in ("src", "dst"):
        rest = rest.join(found.select(F.col("node").alias(c)).hint("merge"), c, "left_anti")
    several = found.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    return found.join(several.hint("merge"), "label", "left_semi").select("node", "label"), stored(rest.select("src", "dst"), "edges")


def strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and label of all nodes on cycles of the edges (src, dst; without loops) in all batches: depth first, by Tarjan."""
    batches = list(batches)
    if not batches:
        return
    kind = batches[0].schema.field(0).type
    src, dst = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in range(2))
    nodes, number = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = number[: len(src)], number[len(src) :]
    order = np.argsort(a, kind="stable")
    heads, starts = b[order].tolist(), np.searchsorted(a[order], np.arange(len(nodes) + 1)).tolist()
    at, seen, low, root, open_ = list(starts), [0] * len(nodes), [0] * len(nodes), [-1] * len(nodes), []
    clock = 0
    for first in range(len(nodes)):
        path = [] if seen[first] else [first]
        while path:
            v = path[-1]
            if not seen[v]:
                clock += 1
                seen[v] = low[v] = clock
                open_.append(v)
            if at[v] < starts[v + 1]:
                w = heads[at[v]]
                at[v] += 1
                if not seen[w]:
                    path.append(w)
                elif root[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                while root[v] < 0:
                    root[open_.pop()] = v
    root = np.array(root)
    cyclic = np.flatnonzero(np.bincount(root, minlength=len(nodes))[root] > 1)
    yield pa.RecordBatch.from_arrays([pa.array(nodes[cyclic], kind), pa.array(nodes[root[cyclic]], kind)], names=["node", "label"])


def cycles(edges: DataFrame) -> DataFrame:
    """node and cycle (the least node of its strongly connected component) of every node on a cycle of edges (src, dst of
    one type, long or string); a node with an edge to itself is one. Nodes before, behind or between cycles are not listed.
    Repeated edges count once, edges with a null end not at all; no edges give no rows."""
    edges = stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    kind = dict(edges.dtypes)["src"]
    own = edges.where("src = dst").select(F.col("src").alias("node"))
    left, logs = edges.where("src <> dst"), []
    label = edges.limit(0).select(F.col("src").alias("node"), F.col("dst").alias("label"))
    for turn in count():
        if (n := left.count()) <= TASK_EDGES:
            if n:
                label = label.unionByName(left.coalesce(1).mapInArrow(strong, f"node {kind}, label {kind}"))
            break
        left, further, looped, moved = contracted(left, turn)
        logs.append((further, looped))
        if not moved:
            found, left = core_components(left)
            label = label.unionByName(found)

    def with_own(label: DataFrame, nodes: DataFrame) -> DataFrame:
        """label, and nodes that have none, as components of their own."""
        return label.unionByName(nodes.join(label.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("label")))

    label = stored(label, "labels")
    for further, looped in reversed(logs):  # partners and neighbours of merged nodes are settled before these
        label = stored(with_own(label, looped), "labels")
        at = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: E731, B023
        settled = further.join(at("p").hint("merge"), "p").join(at("q").hint("merge"), "q").where("p_label = q_label").select("node", F.col("p_label").alias("label"))
        label = stored(label.unionByName(settled.distinct()), "labels")
    label = with_own(label, own)
    least = label.groupBy("label").agg(F.min("node").alias("cycle"))
    return label.join(least.hint("merge"), "label").select("node", "cycle")
