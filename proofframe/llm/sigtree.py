"""Exact n-gram Jaccard join with signature trees.

A document's set is that of its word shingles, as 64-bit hashes (two different shingles or sets share a hash with a
chance of 2^-64, which is taken as never). Documents with one set are one class, named by the set's hash.

Bucketing. Two sets that link differ in at most d shingles, d following from their sizes. Sizes fall into classes such
that linked sets are in one class or in neighbours; for either case the hash space is cut into more than d parts, so
linked sets agree on a whole part that is not empty (sets with many empty parts also agree by those). The hash of a
part's shingles is a bucket. No pair is lost, and sets that merely share frequent shingles or a passage do not meet.

Tree. The classes of a bucket are leaves of a signature tree: nodes hold the OR of their leaves' token bitmaps and the
range of their sizes. A traversal of node pairs drops a pair when its largest possible overlap, from the sizes and
from the bits that one side lacks, is below what the threshold asks; what is left is verified on the whole sets.

Order of work. First every class of a bucket meets the bucket's leader only, then some other leaders: leaf against leaf, by
the tree's bound, and what it lets through is verified. Buckets that are wholly one component then need no more; in the
others all pairs of different components go through the tree. So a group of thousands of near copies costs its size, not
its square, and links between components are all found.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components as star
from ..storage import discarded, freed
from .common import docs_text, slices, written
from .shingles import Parts, Sets, Shingler, text_bytes

BATCH_BYTES = 1_000_000
FANOUT = 4
LEADERS = 1  # further leaders that buckets meet before the trees
BITS, MOST_BITS = 16, 1 << 18  # bits of a bitmap for each shingle, and of one bitmap
BLOCK_BYTES = 8_000_000  # of bitmaps that a tree holds; larger buckets are split into pairs of blocks
PAIRS_BYTES = 8_000_000  # of bitmaps that one step of a traversal compares
BROADCAST_ROWS = 1_000_000  # 16 bytes each
TASK_PAIRS = 500  # of one class, verified by one task


def linked(x: np.ndarray, y: np.ndarray, t: Fraction) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    both = int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small)) if len(large) else 0
    return both > 0 and t.denominator * both >= t.numerator * (len(x) + len(y) - both)


class SignatureTree:
    """Leaves are classes: token bitmap, size, label. An inner node holds FANOUT nodes: the OR of their bitmaps, the
    range of their sizes, the most shingles that share a bit within a leaf (slack), and the range of labels.

    levels[0] are the leaves by bitmap and size, so that nodes hold alike ones."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, labels: np.ndarray):
        self.order = np.lexsort((sizes, *bits.T[::-1]))
        low, union, lo, label = sizes[self.order], bits[self.order], labels[self.order], labels[self.order]
        high, slack = low, low - np.bitwise_count(union).sum(1).astype(np.int64)
        self.levels = [(low, high, union, slack, lo, label)]
        while len(low) > 1:
            at = np.arange(0, len(low), FANOUT)
            low, high, union, slack = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.bitwise_or.reduceat(union, at), np.maximum.reduceat(slack, at)
            lo, label = np.minimum.reduceat(lo, at), np.maximum.reduceat(label, at)
            self.levels.append((low, high, union, slack, lo, label))

    def pairs(self, other: SignatureTree, t: Fraction, tested: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Leaf pairs of different labels that may link, by a traversal of both trees from the roots; pairs of one tree
        with itself once. The traversal goes depth first and compares PAIRS_BYTES of bitmaps at a time, so its memory
        is bounded, whatever is left of the pairs. tested: gets the numbers of node pairs compared, from the leaves up."""
        most = max(1, PAIRS_BYTES // (8 * self.levels[0][2].shape[1]))
        depth = max(len(self.levels), len(other.levels)) - 1
        todo = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        if tested is not None:
            tested += [0] * (depth + 1)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while todo:
            depth, i, j = todo.pop()
            if len(i) > most:
                todo.append((depth, i[most:], j[most:]))
                i, j = i[:most], j[:most]
            if tested is not None:
                tested[depth] += len(i)
            keep = possible([x[i] for x in self.levels[min(depth, len(self.levels) - 1)]], [x[j] for x in other.levels[min(depth, len(other.levels) - 1)]], t, depth == 0)
            i, j = i[keep], j[keep]
            if depth == 0:
                own = i != j if self is other else slice(None)
                out.append((i[own], j[own]))
            elif len(i):
                i, j = descend(i, j, depth, self.levels, other.levels)
                if self is other:
                    i, j = i[i <= j], j[i <= j]
                todo.append((depth - 1, i, j))
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out, strict=True) if out else ((), ())))
        return self.order[i], other.order[j]


def descend(i: np.ndarray, j: np.ndarray, depth: int, mine: list, others: list) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs; a tree that ends above waits."""
    kids_i = i[:, None] * FANOUT + np.arange(FANOUT) if depth < len(mine) else i[:, None]
    kids_j = j[:, None] * FANOUT + np.arange(FANOUT) if depth < len(others) else j[:, None]
    x = np.repeat(kids_i, kids_j.shape[1], axis=1).ravel()
    y = np.tile(kids_j, (1, kids_i.shape[1])).ravel()
    there = (x < len(mine[min(depth - 1, len(mine) - 1)][0])) & (y < len(others[min(depth - 1, len(others) - 1)][0]))
    return x[there], y[there]


def possible(a: list[np.ndarray], b: list[np.ndarray], t: Fraction, leaves: bool) -> np.ndarray:
    """Whether some pair below two nodes may reach the threshold and has different labels.

    Shingles in both sets set bits in both bitmaps, and no more of them share bits than a leaf's slack: the overlap is
    at most the bits in both ORs and the smaller slack together, and at most the smaller size. Between leaves every bit
    that one side alone has is a shingle outside the overlap."""
    (low_a, high_a, bits_a, slack_a, lo_a, hi_a), (low_b, high_b, bits_b, slack_b, lo_b, hi_b) = a, b
    num, den = t.numerator, t.denominator
    both = np.bitwise_count(bits_a & bits_b).sum(1).astype(np.int64)
    most = np.minimum(both + np.minimum(slack_a, slack_b), np.minimum(high_a, high_b))
    if leaves:
        only_a, only_b = high_a - slack_a - both, high_b - slack_b - both
        most = np.minimum(most, np.minimum(high_a - only_a, high_b - only_b))
    ok = (num + den) * most >= num * (low_a + low_b)
    ok &= den * np.minimum(high_a, high_b) >= num * np.maximum(low_a, low_b)
    return ok & ~((lo_a == hi_a) & (lo_b == hi_b) & (lo_a == lo_b))


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each hash modulo the width, the power of two near BITS times the set's size, from 64 to MOST_BITS: few
    shingles share a bit, so that bitmaps tell nearly how far sets are apart."""
    width = 1 << max(6, round(log2(min(BITS * len(s), MOST_BITS))))
    out = np.zeros(width, bool)
    out[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def components(links: DataFrame) -> DataFrame:
    return star(links.select(F.col("x").alias("src"), F.col("y").alias("dst")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key: the doc_id, or a hash of the text where that is null."""
    return docs_text(docs).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, label) after further links (x, y): components of the labels that the links join."""
    name = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    edges = links.join(name("x"), "x", "left").join(name("y"), "y", "left")
    joined = written(components(edges.select(F.coalesce("x_label", "x").alias("x"), F.coalesce("y_label", "y").alias("y"))), "labels")
    up = joined.select(F.col("node").alias("label"), F.col("label").alias("up"))
    old = label.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return written(old.unionByName(joined.join(label, "node", "left_anti")), "labels")


def counted(small: DataFrame) -> DataFrame:
    """A table of few longs, written, and broadcast where it has at most BROADCAST_ROWS."""
    small = written(small, "counted")
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def attached(pairs: DataFrame, sets: DataFrame, end: str, columns: dict[str, str]) -> DataFrame:
    """pairs with columns of sets (by their new names) of the class at one end. The pairs of a class with more than
    TASK_PAIRS are dealt to several tasks and its row to each of them."""
    busy = counted(pairs.groupBy(end).agg(F.ceil(F.count("*") / TASK_PAIRS).cast("int").alias("tasks")).where("tasks > 1"))
    dealt = pairs.join(busy, end, "left").withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.coalesce("tasks", F.lit(1))).cast("int")).drop("tasks")
    copies = sets.select(F.col("a").alias(end), *(F.col(c).alias(n) for c, n in columns.items())).join(busy, end, "left")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    return dealt.join(copies, [end, "salt"]).drop("salt")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("a")).union(pairs.select("y")).distinct()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0) if len(bits) > words else bits


def near(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int, t: Fraction) -> bool:
    """Whether two leaves may link, by their bitmaps and sizes."""
    words = min(len(a), len(b))
    a, b = folded(a, words), folded(b, words)
    leaves = [[np.array([n]), np.array([n]), x[None], np.array([n - int(np.bitwise_count(x).sum())]), np.array([i]), np.array([i])] for i, (x, n) in enumerate(((a, size_a), (b, size_b)))]
    return bool(possible(*leaves, t, True)[0])


def traverse(parts: list[tuple[list[np.ndarray], list[np.ndarray]]], t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of classes of one pair of blocks that the trees let through. parts: the rows' columns and bitmaps."""
    _, i, j, block, a, label, size = (np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True))
    maps = [m for p in parts for m in p[1]]
    words = min(map(len, maps))
    bits = np.stack([folded(m, words) for m in maps])
    left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
    if not len(left) or not len(right):
        return a[:0], a[:0]
    tree = SignatureTree(size[left], bits[left], label[left])
    x, y = tree.pairs(tree if i[0] == j[0] else SignatureTree(size[right], bits[right], label[right]), t)
    x, y = a[left[x]], a[right[y]]
    return np.minimum(x, y), np.maximum(x, y)


def pairs_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*found, strict=True) if found else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])


class JaccardJoin:
    """The join's steps for shingles of `width` words and a threshold."""

    def __init__(self, width: int = 5, threshold: Fraction = Fraction(8, 10)):
        self.width, self.t = width, threshold

    def map_sets(self, rows: DataFrame, make, schema: str) -> DataFrame:
        """make(rows, their sets) of batches; the second column of rows is text."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(width)
            for batch in batches:
                data, bounds = text_bytes(batch.column(1))
                for a, b in slices(np.diff(bounds).tolist(), BATCH_BYTES):
                    yield make(batch.slice(a, b - a), shingler.sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]))

        return rows.mapInArrow(run, schema)

    def classes(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, a (the set's hash) and key (of the text, where doc_id is null) of every document."""

        def make(batch: pa.RecordBatch, sets: Sets) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets.sizes), pa.array(sets.ids()), batch.column(2)], names=["doc_id", "n_shingles", "a", "key"])

        return self.map_sets(keyed(docs), make, "doc_id long, n_shingles long, a long, key long")

    def members(self, docs: DataFrame) -> DataFrame:
        """bucket, leader, a: the classes of buckets that hold several, each beside a leader of its bucket.

        Equal texts of a batch bring their buckets once. A bucket needs no more than its rows in order: it is
        streamed, whatever its size."""
        t = self.t

        def make(batch: pa.RecordBatch, sets: Sets) -> pa.RecordBatch:
            ids, first = np.unique(sets.ids(), return_index=True)
            key, owner = Parts(t).buckets(sets.of(first))
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[owner])], names=["bucket", "a"])

        def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows by (bucket, a): a bucket's first class leads the others; lone classes and repeats go."""
            key = lead = last = None
            for batch in batches:
                k, a = (np.asarray(c) for c in batch.columns)
                if not len(k):
                    continue
                head = a[np.searchsorted(k, k)]  # k ascends
                if k[0] == key:
                    head = np.where(k == key, lead, head)
                keep = head != a
                keep[1:] &= (k[1:] != k[:-1]) | (a[1:] != a[:-1])
                keep[0] &= k[0] != key or a[0] != last
                key, lead, last = int(k[-1]), int(head[-1]), int(a[-1])
                yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(head[keep]), pa.array(a[keep])], names=["bucket", "leader", "a"])

        rows = self.map_sets(docs_text(docs), make, "bucket long, a long")
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "a").mapInArrow(star, "bucket long, leader long, a long")

    def sets_of(self, docs: DataFrame, reps: DataFrame) -> DataFrame:
        """a, shingles (sorted hashes as bytes), their number n and bitmap of the classes in reps (key, a), for each row of
        docs that has the key; see one_each."""

        def make(batch: pa.RecordBatch, sets: Sets) -> pa.RecordBatch:
            ids, want = sets.ids(), np.asarray(batch.column(3))
            keep = np.flatnonzero(ids == want)
            own = [sets[i] for i in keep]
            return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(sets.sizes[keep]), pa.array([bitmap(s).tobytes() for s in own], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], names=["a", "n", "bits", "shingles"])

        small = reps.count() <= BROADCAST_ROWS
        rows = keyed(docs).join(F.broadcast(reps) if small else reps, "key").select("doc_id", "text", "key", "a")
        return self.map_sets(rows, make, "a long, n long, bits binary, shingles binary")

    def tested(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (x, y) that the bound of the tree's leaves lets through: most of those that share no more than a
        passage end here, for an eighth of the bytes of their sets or a quarter."""
        t = self.t

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, n, m, p, q = (c.to_pylist() for c in batch.columns)
                keep = [near(np.frombuffer(a, np.uint64), i, np.frombuffer(b, np.uint64), j, t) for a, i, b, j in zip(p, n, q, m, strict=True)]
                yield pairs_batch([(np.array(x, np.int64)[keep], np.array(y, np.int64)[keep])] if keep else [])

        with_y = attached(pairs.select("x", "y"), sets, "y", {"n": "m", "bits": "q"})
        both = attached(with_y, sets, "x", {"n": "n", "bits": "p"})
        return both.select("x", "y", "n", "m", "p", "q").mapInArrow(run, "x long, y long")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (x, y) whose sets reach the threshold. sets has one row for a class; that of a class with many pairs
        is sent to several tasks."""
        t = self.t

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y, p, q = (c.to_pylist() for c in batch.columns)
                keep = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), t) for a, b in zip(p, q, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (x, y)], names=["x", "y"])

        pairs = written(pairs, "pairs")
        sets = sets.join(counted(ends(pairs)), "a", "left_semi")
        both = attached(attached(pairs.select("x", "y"), sets, "y", {"shingles": "q"}), sets, "x", {"shingles": "p"})
        return both.select("x", "y", "p", "q").mapInArrow(run, "x long, y long")

    def tree_pairs(self, open_buckets: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs of different labels (bucket, a, label) that the signature trees of their buckets let through."""
        t = self.t
        rows = open_buckets.join(sets.select("a", "n", F.octet_length("bits").alias("bytes")), "a")
        counts = rows.groupBy("bucket").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
        rows = rows.join(counts, "bucket").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
        # a block meets every block of its bucket once: as (small, large)
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "a", "label")
        rows = rows.join(sets.select("a", "n", "bits"), "a")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows by (bucket, i, j): what one of these has is held, no more."""
            names, held = ["bucket", "i", "j", "block", "a", "label", "n"], []
            for batch in batches:
                cols = [np.asarray(batch.column(c)) for c in names]
                maps = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("bits")]
                ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1 if len(maps) else []
                found = []
                for p, q in zip([0, *ends], [*ends, len(maps)], strict=True):
                    if p == q:
                        continue
                    if held and any(c[p] != h[0] for c, h in zip(cols[:3], held[-1][0], strict=False)):
                        found.append(traverse(held, t))
                        held = []
                    held.append(([c[p:q].copy() for c in cols], [m.copy() for m in maps[p:q]] if q == len(maps) else maps[p:q]))
                yield pairs_batch(found)
            yield pairs_batch([traverse(held, t)] if held else [])

        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        return rows.mapInArrow(run, "x long, y long").distinct()

    def run(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(doc_id, n_shingles, a) of all documents, (node, label) of linked classes, and links (x, y) between classes
        that were verified; between linked classes of one component not every link is listed."""
        spark = docs.sparkSession
        ids = written(self.classes(docs), "classes")
        members = written(self.members(docs), "members")
        freed(spark)
        pairs = members.select(F.least("leader", "a").alias("x"), F.greatest("leader", "a").alias("y")).distinct()
        pairs = written(pairs, "pairs")
        wanted = members.select("a").union(members.select("leader")).distinct()
        reps = written(ids.where("n_shingles > 0").join(wanted, "a", "left_semi").groupBy("a").agg(F.min("key").alias("key")), "reps")
        sets = self.one_each(written(self.sets_of(docs, reps), "sets"), reps)
        links = written(self.verified(self.tested(pairs, sets), sets), "links")
        label = written(components(links), "labels")
        named = written(self.shared(members), "buckets")
        for done in (members, reps, pairs):
            discarded(done)
        freed(spark)
        for turn in range(LEADERS):
            open_ = self.open_buckets(named, label, turn)
            star = open_.where("label <> leader.label").select(F.least("a", "leader.a").alias("x"), F.greatest("a", "leader.a").alias("y")).distinct()
            more = written(self.verified(self.tested(written(star, "pairs"), sets), sets), "links")
            freed(spark)
            if more.isEmpty():
                break
            links, label = links.unionByName(more), merged(label, more)
        open_ = written(self.open_buckets(named, label, 0).drop("leader"), "open")
        discarded(named)
        more = written(self.verified(self.tree_pairs(open_, sets), sets), "links")
        freed(spark)
        if not more.isEmpty():
            links, label = links.unionByName(more), merged(label, more)
        discarded(sets)
        return ids, label, links

    def one_each(self, sets: DataFrame, reps: DataFrame) -> DataFrame:
        """sets with one row for a class: rows that repeat a document have brought its class as often."""
        if sets.count() <= reps.count():
            return sets
        one = written(sets.dropDuplicates(["a"]), "sets")
        discarded(sets)
        return one

    def shared(self, members: DataFrame) -> DataFrame:
        """bucket, a of buckets of three classes or more, one bucket for each set of classes. A bucket of two has been
        verified whole by its leader."""
        facts = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a").cast("decimal(38,0)")).alias("alike"), F.first("leader").alias("leader"))
        facts = facts.where("n > 1").groupBy("alike", "n", "leader").agg(F.min("bucket").alias("bucket")).select("bucket", "leader")
        rest = members.select("bucket", "a").join(facts.select("bucket"), "bucket", "left_semi")
        return facts.select("bucket", F.col("leader").alias("a")).unionByName(rest)

    def open_buckets(self, named: DataFrame, label: DataFrame, turn: int) -> DataFrame:
        """bucket, a, label and leader (a, label) of buckets that hold several components; the leader is another class
        each turn."""
        rows = named.join(label.withColumnRenamed("node", "a"), "a", "left").select("bucket", "a", F.coalesce("label", "a").alias("label"))
        facts = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("a", "label"), F.xxhash64("a", F.lit(turn))).alias("leader"))
        return rows.join(facts.where("lo <> hi").select("bucket", "leader"), "bucket")

    def groups(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included).

        Null and empty texts have no shingles and are linked with nothing; a text of fewer words than a shingle is one
        shingle; repeated rows are in one component; other columns are not read. An empty table gives no rows.
        """
        ids, label, _ = self.run(docs)
        named = ids.join(label.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
        full = F.col("n_shingles") > 0
        least = named.where(full).groupBy("label").agg(F.min("doc_id").alias("least"))
        out = named.join(least, "label", "left")
        return out.select("doc_id", "n_shingles", F.when(full, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """docs with one document of each component, that of the smallest doc_id; of repeated doc_ids one row stays.

        Documents without shingles (null or empty texts) are linked with nothing and all stay; null doc_ids stay."""
        kept = self.groups(docs.where("doc_id is not null")).where("doc_id = component_id").select("doc_id").distinct()
        repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count()
        out = docs.join(kept, "doc_id", "left_semi").select(docs.columns)
        out = out.dropDuplicates(["doc_id"]) if repeated else out
        return out.unionByName(docs.where("doc_id is null"))
