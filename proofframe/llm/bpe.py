"""Byte-level BPE encoding and decoding with a segment tree.

The leaves of a tree are the byte positions of one pre-token; the leaf of a position that starts a live symbol holds
the rank of the pair that this symbol forms with its right neighbour, beside the position, and inner nodes hold the
smallest value below. So the root is the leftmost pair of minimum rank. A merge changes three leaves (the merged
symbol, the one it swallowed, its left neighbour) and the nodes above them: logarithmic work for each merge.

Pre-tokens of up to SHORT bytes are merged many at a time, as rows of one array; longer ones one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import WordCache, cut_long, docs_text, slices

SHORT = 64
INF = np.iinfo(np.int64).max
BATCH_CHARS = 2_000_000


class SegmentTreeBPE:
    """ranks: bytes of every token to its id, which is also its merge rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        for t, i in ranks.items():
            for k in range(1, len(t)):
                if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                    self.pairs[a << 20 | b] = i
        keys = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], INF)
        self.values = np.append(np.fromiter(self.pairs.values(), np.int64, len(self.pairs))[order], -1)
        self.dtype = np.dtype("<u2" if len(self.tokens) <= 1 << 16 else "<u4")

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 20 | right
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.values[at], INF)

    def merge_many(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most width bytes; width is a power of two of at least 2."""
        n, bits = len(words), width.bit_length() - 1
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        length = np.fromiter(map(len, words), np.int64, n)
        place = np.arange(width)
        token = np.zeros((n, width + 1), np.int64)
        token[:, :width] = self.byte_ids[raw]
        live = place < length[:, None]
        right = np.minimum(place + 1, length[:, None])  # length: no right neighbour
        left = np.tile(np.arange(-1, width), (n, 1))  # column width takes writes that mean nothing
        tree = np.full((n, 2 * width), INF, np.int64)
        rank = self.pair_ranks(token[:, : width - 1].ravel(), token[:, 1:width].ravel()).reshape(n, width - 1)
        has = (place[: width - 1] + 1 < length[:, None]) & (rank < INF)
        tree[:, width : 2 * width - 1] = np.where(has, rank << bits | place[: width - 1], INF)
        node = width
        while node > 1:
            half = node // 2
            tree[:, half:node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
            node = half

        def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            at = at + width
            tree[rows, at] = value
            for _ in range(bits):
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        rows = np.nonzero(tree[:, 1] < INF)[0]
        while rows.size:
            best = tree[rows, 1]
            at, merged = best & (width - 1), best >> bits
            gone = right[rows, at]
            after = right[rows, gone]
            token[rows, at] = merged
            live[rows, gone] = False
            right[rows, at] = after
            left[rows, after] = at
            update(rows, gone, np.full(rows.size, INF))
            r = np.where(after < length[rows], self.pair_ranks(merged, token[rows, after]), INF)
            update(rows, at, np.where(r < INF, r << bits | at, INF))
            before = left[rows, at]
            some = before >= 0
            if some.any():
                rs, b = rows[some], before[some]
                r = self.pair_ranks(token[rs, b], merged[some])
                update(rs, b, np.where(r < INF, r << bits | b, INF))
            rows = rows[tree[rows, 1] < INF]
        flat = token[:, :width][live].astype(self.dtype).tobytes()
        ends = (np.cumsum(live.sum(1)) * self.dtype.itemsize).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_one(self, word: bytes) -> np.ndarray:
        """Ids of one word of any length."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        bits, none, pairs = width.bit_length() - 1, int(INF), self.pairs
        token = [int(self.byte_ids[b]) for b in word]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = pairs.get(token[i] << 20 | token[i + 1])
            if r is not None:
                tree[width + i] = r << bits | i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(at: int, value: int) -> None:
            at += width
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a < b else b
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1

        def leaf(i: int) -> None:
            j = right[i]
            r = pairs.get(token[i] << 20 | token[j]) if j < n else None
            update(i, none if r is None else r << bits | i)

        while tree[1] != none:
            at, merged = tree[1] & (width - 1), tree[1] >> bits
            gone = right[at]
            token[at], token[gone] = merged, -1
            right[at] = right[gone]
            if right[at] < n:
                left[right[at]] = at
            update(gone, none)
            leaf(at)
            if left[at] >= 0:
                leaf(left[at])
        return np.array([t for t in token if t >= 0], self.dtype)

    def encode_pretokens(self, words: list[bytes]) -> list[bytes]:
        """Ids, as bytes, of each pre-token; one that is a token itself is that token."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if (i := self.ranks.get(w)) is not None:
                out[k] = i.to_bytes(self.dtype.itemsize, "little")
            elif len(w) > SHORT:
                out[k] = self.merge_one(w).tobytes()
            else:
                groups.setdefault(1 << max(1, (len(w) - 1).bit_length()), []).append(k)
        for width, at in groups.items():
            for a in range(0, len(at), 8192):
                some = at[a : a + 8192]
                for k, ids in zip(some, self.merge_many([words[k] for k in some], width), strict=True):
                    out[k] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TextEncoder:
    """Whole texts to ids. Pieces between spaces repeat, so each is split by the pattern and merged once. A
    piece that is empty or begins with white space may belong to a longer run of it: such a text is matched whole."""

    def __init__(self, bpe: SegmentTreeBPE, pattern: str, limit: int = 300_000):
        self.bpe, self.pattern, self.limit = bpe, regex.compile(pattern), limit
        self.pretokens: dict[str, bytes] = {}
        self.words = WordCache(lambda pieces: self.encode_strings([" " + p for p in pieces]), limit)

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        """Ids, as bytes, of strings that the pattern splits each by itself. It leaves letters together, with a space
        before them, and a comma or full stop after them apart; other strings are matched."""
        split: list[tuple | list] = []
        for x in strings:
            core = x[1:] if x[:1] == " " else x
            if core.isalpha():
                split.append((x,))
            elif core[-1:] in (".", ",") and core[:-1].isalpha():
                split.append((x[:-1], core[-1]))
            else:
                split.append(self.pattern.findall(x))
        new = set().union(*split).difference(self.pretokens)
        if len(self.pretokens) + len(new) > self.limit:
            self.pretokens = {}
            new = set().union(*split)
        new = list(new)
        self.pretokens.update(zip(new, self.bpe.encode_pretokens([w.encode() for w in new]), strict=True))
        ids = self.pretokens
        return [ids[w[0]] if len(w) == 1 else b"".join([ids[x] for x in w]) for w in split]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The first piece of a text has no space before it: it is encoded apart; very long texts go in parts."""
        parts, owner = [], []
        for k, t in enumerate(texts):
            for p in cut_long(t):
                parts.append(p)
                owner.append(k)
        lists = [p.split(" ") for p in parts]
        odd = {w for w in set().union(*lists).difference(self.words.cache) if not w or w[0].isspace()}  # never cached
        heads, tails = [], []
        for p, words in zip(parts, lists, strict=True):
            bad = bool(odd) and not odd.isdisjoint(words[1:])
            heads.append(p if bad else words[0])
            tails.append([] if bad else words[1:])
        distinct = list(set(heads))
        first = dict(zip(distinct, self.encode_strings(distinct), strict=True))
        out: list[list[bytes]] = [[] for _ in texts]
        for k, h, tail in zip(owner, heads, self.words.blobs(tails), strict=True):
            out[k] += [first[h], tail]
        return [np.frombuffer(b"".join(x), self.bpe.dtype) for x in out]


@lru_cache(2)
def encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(SegmentTreeBPE(load_ranks(path)), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the bytes that the ids decode to) of every whole text.

    Null texts are empty ones: no ids, no bytes. Repeated rows stay; other columns are not read. ranks_path names a
    vocabulary file that every executor has (it is part of the installation), not a file in the repository.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(map(len, texts), BATCH_CHARS):
                ids = enc.encode(texts[a:b])
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))),
                        pa.array([enc.bpe.decode(x) for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_documents without its large columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows: list[tuple[int, str, str]] = []
            for a, b in slices(map(len, texts), BATCH_CHARS):
                for ids in enc.encode(texts[a:b]):
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(enc.bpe.decode(ids)).hexdigest()))
            n, x, y = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
