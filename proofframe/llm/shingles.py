"""Sets of word shingles as sorted 64-bit hashes, many texts at a time, and their cuts into parts.

Two different shingles or sets share a hash with a chance of 2^-64, which is taken as never.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, exp

import numpy as np
import pyarrow as pa

WINDOW = 1 << 19  # bytes whose words are hashed at a time


def mix(x: np.ndarray) -> np.ndarray:
    z = x + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def random_odd(start: int, end: int) -> np.ndarray:
    return mix(np.arange(start, end, dtype=np.uint64)) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column without nulls, and the n + 1 bounds of the texts in them."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


class Sets:
    """Sets of texts side by side: values[bounds[i] : bounds[i + 1]] ascend."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray):
        self.values, self.bounds = values, bounds
        self.sizes = np.diff(bounds)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.bounds[i] : self.bounds[i + 1]]

    def ids(self) -> np.ndarray:
        """A hash of each set."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        return (total[self.bounds[1:]] - total[self.bounds[:-1]]).view(np.int64)

    def of(self, numbers: np.ndarray) -> Sets:
        return Sets(np.concatenate([self[i] for i in numbers] or [self.values[:0]]), np.concatenate([[0], np.cumsum(self.sizes[numbers])]).astype(np.int64))


class Shingler:
    """Distinct shingle hashes of texts, from their bytes. A word's hash is the sum, over its bytes, of a random number
    for the byte (capitals A to Z have that of their small letter) times one for its place; a shingle's likewise of its
    words'. Words are what ASCII white space leaves."""

    def __init__(self, width: int):
        self.width = width
        number = np.arange(256)
        self.letter = random_odd(0, 256)[np.where((number >= 65) & (number < 91), number + 32, number)]
        self.factors = random_odd(1000, 1000 + width)
        self.inside = ~np.isin(number, list(b" \t\n\v\f\r"))
        self.place = random_odd(10_000, 10_064)

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of data in order, and where they begin; texts end words."""
        hashes, starts, a = [], [], 0
        while a < len(data):
            b = self.cut(data, a + WINDOW)
            own = bounds[np.searchsorted(bounds, a) : np.searchsorted(bounds, b)] - a
            h, s = self.window(data[a:b], own)
            hashes.append(h)
            starts.append(s + a)
            a = b
        return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *starts])

    def cut(self, data: np.ndarray, at: int) -> int:
        """The first place from at on that is white space, or the end."""
        while at < len(data):
            space = np.flatnonzero(~self.inside[data[at : at + 4096]])
            if len(space):
                return at + int(space[0])
            at += 4096
        return len(data)

    def window(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = self.inside[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        begin[bounds] = inside[bounds]
        start = np.flatnonzero(begin)
        if not len(start):
            return np.zeros(0, np.uint64), start
        runs = np.concatenate([[0], start, [len(data)]])
        place = np.arange(len(data)) - np.repeat(runs[:-1], np.diff(runs))
        place[~inside] = 0
        while len(self.place) <= place.max():
            self.place = random_odd(10_000, 10_000 + 2 * len(self.place))
        value = self.letter[data] * self.place[place]
        value[~inside] = 0
        return mix(np.add.reduceat(value, start)), start

    def sets(self, data: np.ndarray, bounds: np.ndarray) -> Sets:
        """The sets of texts; bounds are theirs in data."""
        flat, start = self.words(data, bounds)
        first = np.searchsorted(start, bounds)
        w, n = self.width, len(flat) - self.width + 1
        run = mix(sum((flat[i : i + n] * self.factors[i] for i in range(w)), np.zeros(n, np.uint64))) if n > 0 else flat[:0]
        out, sizes = [], np.zeros(len(bounds) - 1, np.int64)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b - a >= w:
                s = np.sort(run[a : b - w + 1])
                fresh = np.concatenate([[True], s[1:] != s[:-1]])
                s = s if fresh.all() else s[fresh]
            elif b > a:  # the whole sequence is one shingle
                s = mix(mix((flat[a:b] * self.factors[: b - a]).sum(keepdims=True)) + np.uint64(b - a))
            else:
                continue
            out.append(s)
            sizes[k] = len(s)
        return Sets(np.concatenate([flat[:0], *out]), np.concatenate([[0], np.cumsum(sizes)]))


class Parts:
    """How sets of a size are cut, for a threshold given as a fraction."""

    def __init__(self, threshold: Fraction):
        self.t, self.first = threshold, [1]
        self.plans: dict[int, tuple[int, int]] = {}

    def grow(self, classes: int) -> None:
        while len(self.first) < classes:
            self.first.append(int(self.first[-1] / self.t) + 1)

    def classes(self, sizes: np.ndarray) -> np.ndarray:
        while self.first[-1] <= sizes.max(initial=0):
            self.grow(len(self.first) + 1)
        return np.searchsorted(self.first, sizes, side="right") - 1

    def plan(self, c: int) -> tuple[int, int]:
        """Parts for pairs whose smaller set is in class c, and the empty ones allowed for. (0, 0): only equal sets."""
        if c not in self.plans:
            self.grow(c + 3)
            small = self.first[c + 1] - 1
            differ = int((small + int(small / self.t)) * (1 - self.t) / (1 + self.t))
            spare = 0
            if differ:
                mean = (differ + 1) * exp(-self.first[c] / (differ + 1))
                spare = min(ceil(2 * mean), (differ + 1) // 6)
            self.plans[c] = (differ + 1 + spare, spare) if differ else (0, 0)
        return self.plans[c]

    def buckets(self, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
        """Bucket hashes of sets that aren't empty, and the number of the set of each."""
        own = self.classes(sets.sizes)
        keys, owners = [], []
        for c, on in ((own, own >= 0), (own - 1, own >= 1)):
            plans = {k: self.plan(k) for k in np.unique(c[on]).tolist()}
            parts = np.array([plans[k][0] if y else 0 for k, y in zip(c.tolist(), on.tolist(), strict=True)], np.int64)
            spare = np.array([plans[k][1] if y else 0 for k, y in zip(c.tolist(), on.tolist(), strict=True)], np.int64)
            size = np.where(parts > 0, sets.sizes, 0)
            s = sets.values[np.repeat(parts > 0, sets.sizes)]
            base = np.cumsum(parts) - parts
            group = (s >> np.uint64(32)) % np.repeat(parts, size).astype(np.uint64)
            group = np.repeat(base, size) + group.astype(np.int64)
            total = np.zeros(int(parts.sum()), np.uint64)
            np.add.at(total, group, mix(s ^ np.uint64(0xA0761D6478BD642F)))
            full = np.bincount(group, minlength=len(total)) > 0
            owner = np.repeat(np.arange(len(parts)), parts)
            empty = parts - np.bincount(owner[full], minlength=len(parts))
            full |= (empty > spare)[owner]
            number = np.arange(len(total)) - base[owner]
            keys.append(mix(total ^ mix((c[owner].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64)))[full])
            owners.append(owner[full])
        return np.concatenate(keys), np.concatenate(owners)
