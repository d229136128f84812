"""Loops over edge tables: closure and levels. Each step is a join and is written to the shared folder."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

DEPTH = 64
#: Rounds after which a walk's rows are written as one, so that plans stay short.
ROUNDS = 16
#: Rounds from which a walk is long; nodes found since are many if there are more than one in so many edges left.
LONG, PRUNED = 4, 5
#: Up to so many rows are broadcast by way of the driver, a few MB.
SMALL = 250_000


def sized(df: DataFrame, n: int) -> DataFrame:
    """df of n rows, broadcast by a join if that is little, else merged: Spark would have each frontier of up to 10 MB
    collected at the driver, round by round."""
    return df.hint("broadcast" if n <= SMALL else "merge")


def reach(seeds: DataFrame, edges: DataFrame, carry: tuple[str, ...] = (), depth: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """carry, node and depth of all nodes reachable from seeds (carry, node) along edges (src, dst), seeds included.

    stop (node): nodes that are reached but not left. Where depth is given, deeper raises: nothing is cut in silence.

    A long walk without carry drops the edges into nodes found, as soon as these are many: later rounds read what is left,
    and compare with the nodes found since alone."""
    keys = [*carry, "node"]
    frontier = seen = since = stored(seeds.select(*keys).distinct().withColumn("depth", F.lit(0)), "reach")
    n = n_since = frontier.count()
    left, n_left = edges, None
    for d in count(1) if depth is None else range(1, depth + 2):
        at = frontier if stop is None else frontier.join(stop, "node", "left_anti")
        if not carry:
            if d > LONG and n_left is None:
                n_left = left.count()
            if d > LONG and n_since * PRUNED > n_left:
                left = stored(left.join(sized(since.select(F.col("node").alias("dst")), n_since), "dst", "left_anti").select("src", "dst"), "left")
                since, n_since, n_left = None, 0, left.count()
            at = sized(at, n)
        new = at.join(left, at["node"] == left["src"]).select(*carry, F.col("dst").alias("node")).distinct()
        if since is not None:
            known = since.select(*keys)
            new = new.join(known if carry else sized(known, n_since), keys, "left_anti")
        frontier = stored(new.withColumn("depth", F.lit(d)), "reach")
        n = frontier.count()
        if not n:
            return seen
        all_since = since is seen
        seen, n_since = seen.unionByName(frontier), n_since + n
        if d % ROUNDS == 0:
            seen = stored(seen, "reach")
        since = seen if all_since else frontier if since is None else since.unionByName(frontier)
    raise RuntimeError(f"deeper than {depth}")


def neighbourhood(seeds: DataFrame, edges: DataFrame, ambiguities: DataFrame, operational: Column) -> DataFrame:
    """node and depth of what belongs to seeds (node): one hop along edges (src, dst) either way, further hops from nodes
    alone for which operational (an expression over src) holds, and all participants of every ambiguity that a node found
    takes part in.

    ambiguities (ambiguity, node) links each participant to its ambiguity, so that one of many participants makes as many
    links and not their square; ambiguities count as nodes, named apart from others."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    to = ambiguities.select(F.col("node").alias("src"), F.col("ambiguity").alias("dst"))
    links = stored(both.where(operational).unionByName(to).unionByName(to.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "links")
    near = both.join(seeds.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    return reach(seeds.select("node").unionByName(near), links)


def levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, level of every node that follows no cycle, the longest way from a source; the nodes left in or behind
    cycles). As many rounds as there are levels."""
    left = stored(edges.select("src", "dst").distinct(), "edges")
    nodes = stored(left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).distinct(), "nodes")
    done = None
    for level in count():
        free = stored(nodes.join(left.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)), "level")
        if free.isEmpty():
            return (free if done is None else done), nodes
        done = free if done is None else done.unionByName(free)
        if level % ROUNDS == ROUNDS - 1:
            done = stored(done, "levels")
        nodes = stored(nodes.join(free, "node", "left_anti"), "nodes")
        left = stored(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"), "edges")


def ancestors(path: Column, sep: str = "/") -> Column:
    """All proper beginnings of a path that end at a separator's place, shortest first, and the path itself."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))
