"""Token-id files with a minimal perfect hash index: constant-time keyed access over raw id payloads.

A store is a Parquet folder, so any file system that Spark reaches can hold it; one row is one shard of SHARD_BYTES
of ids or so, and its column `blob` is the shard file:

    8 bytes   magic PFIDS002
    7 x int64 keys n, distinct keys m, id width in bytes, hash seed, buckets b, payload bytes, null keys
    n x int64 document keys in payload order (ascending; null keys stand first, as the smallest int64)
    n+1 int64 byte offsets into the payload
    b x int64 displacements of the minimal perfect hash; negative: -1 - slot
    m x int64 slots: the first record of the key
    m x int32 fingerprints of the slots' keys
    payload   ids, little-endian unsigned

The hash is compress-hash-displace: keys fall into buckets, the fullest first get a displacement that sends all their
keys to free slots, buckets of one key name a free slot outright. A lookup hashes the key, reads one displacement and
one slot, and compares the stored fingerprint, then the stored key (fingerprints turn most strangers away without
touching the keys).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import docs_text, slices
from .token_ids import token_ids

MAGIC = b"PFIDS002"
SHARD_BYTES = 4_000_000
TRIES = 1 << 15
NULL_KEY = -(1 << 63)
BATCH_BYTES = 2_000_000


def mix(x: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of keys, another one for each seed."""
    z = x.astype(np.uint64) + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def slot_of(h: np.ndarray, d: np.ndarray, m: int) -> np.ndarray:
    return mix(h, d) % np.uint64(m)


def build_hash(keys: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Seed, displacements and the slot of each of the distinct keys."""
    m = len(keys)
    b = max(1, m // 3)
    for seed in range(1, 50):
        h = mix(keys, seed)
        bucket = (mix(keys, seed + 7919) % np.uint64(b)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=b)
        ends = np.cumsum(counts)
        disp, slots, free = np.zeros(b, np.int64), np.full(m, -1, np.int64), np.ones(m, bool)
        done = True
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] <= 1:
                break
            own = order[ends[k] - counts[k] : ends[k]]
            d = 0
            for base in range(1, TRIES, 512):
                tries = slot_of(h[own][None, :], np.arange(base, base + 512)[:, None], m).astype(np.int64)
                good = free[tries].all(1)
                tries.sort(1)
                good &= (tries[:, 1:] != tries[:, :-1]).all(1)
                if good.any():
                    d = base + int(good.argmax())
                    break
            if not d:
                done = False
                break
            disp[k] = d
            slots[own] = at = slot_of(h[own], np.full(len(own), d), m).astype(np.int64)
            free[at] = False
        if done:
            ones = np.nonzero(counts == 1)[0]
            rest = np.nonzero(free)[0]
            disp[ones] = -1 - rest[: len(ones)]
            slots[order[ends[ones] - 1]] = rest[: len(ones)]
            return seed, disp, slots
    raise ValueError("no seed separates these keys")


def build_shard(keys: list[int], blobs: list[bytes], width: int, nulls: int = 0) -> bytes:
    """The shard file of records whose keys ascend; equal keys stand side by side. The first `nulls` keys are null."""
    key = np.array(keys, np.int64)
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    distinct = key[first]
    seed, disp, slots = build_hash(distinct)
    head = np.zeros(len(distinct), np.int64)
    prints = np.zeros(len(distinct), np.int32)
    head[slots] = first
    prints[slots] = (mix(distinct, seed + 104729) & np.uint64(0x7FFFFFFF)).astype(np.int32)
    offsets = np.cumsum([0, *map(len, blobs)]).astype(np.int64)
    return b"".join([MAGIC, struct.pack("<7q", len(key), len(distinct), width, seed, len(disp), int(offsets[-1]), nulls), key.tobytes(), offsets.tobytes(), disp.tobytes(), head.tobytes(), prints.tobytes(), *blobs])


class Shard:
    """A shard file, opened for keyed access."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a token-id shard")
        n, self.m, self.width, self.seed, self.b, size, self.nulls = struct.unpack_from("<7q", blob, 8)
        at = 64
        take = []
        for count, kind in ((n, np.int64), (n + 1, np.int64), (self.b, np.int64), (self.m, np.int64), (self.m, np.int32)):
            take.append(np.frombuffer(blob, kind, count, at))
            at += count * np.dtype(kind).itemsize
        self.keys, self.offsets, self.disp, self.head, self.prints = take
        self.payload = memoryview(blob)[at : at + size]
        if len(self.payload) != size:
            raise ValueError("truncated token-id shard")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, or -1."""
        h = mix(keys, self.seed)
        d = self.disp[(mix(keys, self.seed + 7919) % np.uint64(self.b)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, slot_of(h, np.maximum(d, 0), self.m).astype(np.int64))
        record = self.head[slot]
        hit = self.prints[slot] == (mix(keys, self.seed + 104729) & np.uint64(0x7FFFFFFF)).astype(np.int32)
        return np.where(hit & (self.keys[record] == keys), record, -1)

    def records(self, key: int | None) -> range:
        """The records of a key; null is a key of its own."""
        if key is None:
            return range(self.nulls)
        first = int(self.find(np.array([key], np.int64))[0])
        if first < 0:
            return range(0)
        return range(max(first, self.nulls if key == NULL_KEY else 0), int(np.searchsorted(self.keys, key, side="right")))

    def ids(self, record: int) -> np.ndarray:
        return np.frombuffer(self.payload[self.offsets[record] : self.offsets[record + 1]], f"<u{self.width}")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Ids of all whole texts, each followed by end_id, in ascending doc_id order, written as shards below path.

    Null texts are empty; null doc_ids come first; repeated rows are written each; other columns are not read. An
    empty table gives a store without shards. Documents are ranged over tasks by doc_id; a task holds one shard at a
    time, so memory is bounded by a shard and the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = token_ids(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        keys: list[int] = []
        blobs: list[bytes] = []
        size = seq = nulls = 0

        def shard() -> pa.RecordBatch:
            cols = [part, seq, keys[0], keys[-1], len(keys), size // width]
            return pa.RecordBatch.from_arrays([*(pa.array([c], pa.int64()) for c in cols), pa.array([build_shard(keys, blobs, width, nulls)], pa.binary())], names=["part", "seq", "first_key", "last_key", "n_docs", "n_ids", "blob"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(pc.binary_length(texts).to_pylist(), BATCH_BYTES):
                found = enc.encode(texts.slice(a, b - a))
                for key, x, n in zip(ids[a:b], found.start.tolist(), found.size.tolist(), strict=True):
                    keys.append(NULL_KEY if key is None else key)
                    nulls += key is None
                    blobs.append(found.ids[x : x + n].tobytes() + end)
                    size += (n + 1) * width
                    if size >= SHARD_BYTES:
                        yield shard()
                        keys, blobs, size, seq, nulls = [], [], 0, seq + 1, 0
        if keys:
            yield shard()

    rows = docs_text(docs)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    rows.mapInArrow(run, "part long, seq long, first_key long, last_key long, n_docs long, n_ids long, blob binary").write.parquet(path)


def read_store(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the shard files alone.

    start counts the ids of all earlier shards and records: shard totals are summed by part, then inside a part.
    """
    meta = store.select("part", "seq", "n_ids")
    parts = meta.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task that wrote
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = meta.withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    at = at.select("part", "seq", (F.col("base") + F.col("own")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = Shard(blob)
                first = s.find(s.keys)
                n = np.diff(s.offsets) // s.width
                start = s.offsets[:-1] // s.width
                rank = np.arange(len(s.keys)) - np.searchsorted(s.keys, s.keys)  # among records of one key
                crc = [zlib.crc32(s.ids(r).astype("<u4").tobytes()) for r in (first + rank).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part)), pa.array(np.full(len(n), seq)), pa.array(s.keys, mask=np.arange(len(n)) < s.nulls), pa.array(start), pa.array(n), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "own", "n_tokens", "ids_crc32"],
                )

    rows = store.select("part", "seq", "blob").mapInArrow(run, "part long, seq long, doc_id long, own long, n_tokens long, ids_crc32 long")
    return rows.join(at, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def lookup(store: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id and ids of the records with the asked doc_ids: keys go to the shards whose key range holds them, then
    through the shard's hash. Every record of a repeated key is returned; strangers give no row."""
    ranges = store.select("part", "seq", "first_key", "last_key")
    parts = ranges.groupBy("part").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high"))  # a row for each task that wrote
    held = lambda low, high: F.coalesce("doc_id", F.lit(NULL_KEY)).between(F.col(low), F.col(high))
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    routed = asked.join(F.broadcast(parts), held("low", "high")).join(ranges, "part").where(held("first_key", "last_key"))
    routed = routed.groupBy("part", "seq").agg(F.collect_list(F.struct("doc_id")).alias("keys"))  # no more than a shard's documents, and strangers between them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = Shard(blob)
                out = [(k["doc_id"], s.ids(r).astype(np.int64).tolist()) for k in wanted for r in s.records(k["doc_id"])]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([v for _, v in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return store.join(routed, ["part", "seq"]).select("blob", "keys").mapInArrow(run, "doc_id long, ids array<long>")
