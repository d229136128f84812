"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to three characters, words padded with
spaces), most frequent first. A text has a profile too; its distance to a language is the sum, over the text's n-grams,
of how far each stands out of place in the language's profile; n-grams that a language lacks count as far as can be.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import rows_and_text, slices

PROFILE = 300
#: At most so many documents of each language are learned from, those of least hash of the id.
TRAIN_DOCS = 3_000
BATCH_CHARS = 500_000
UND = "und"
BROADCAST_LANGS = 200  # so many languages at most have their numbers and picked ids broadcast
SPACE = 1
BITS = 21  # of a code
#: Distance beyond which a text is in none of the languages. The labelled documents of all given tables stay below 0.65; random letters, base64 and hexadecimal digits are at 0.8 and more.
FAR = 0.75


@lru_cache(1)
def letters() -> np.ndarray:
    """A code for every code point: 1 (SPACE) for all that is not a letter, else the small letter's code point and 1."""
    out = np.full(0x110000, SPACE, np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0]) + 1
    return out


def codes_of(text: str) -> np.ndarray:
    """Codes of a text between spaces; runs of anything but letters are one space."""
    c = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    c = np.concatenate([[SPACE], c, [SPACE]]).astype(np.int64)
    return c[np.concatenate([[True], (c[1:] != SPACE) | (c[:-1] != SPACE)])]


def grams(c: np.ndarray, bits: int = BITS) -> np.ndarray:
    """n-grams of codes, `bits` bits a code: letters, pairs (spaces stand alone, so at least one letter), triples around
    a letter. A code is never 0, so keys of different lengths differ."""
    mid = c[1:-1] != SPACE
    return np.concatenate([c[c != SPACE], c[:-1] << bits | c[1:], (c[:-2] << 2 * bits | c[1:-1] << bits | c[2:])[mid]])


def summed(doc: np.ndarray, gram: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, gram), in order, with the sum of n, or with their number."""
    name, number = np.unique(gram, return_inverse=True)
    key, back = np.unique(doc * len(name) + number, return_inverse=True)
    total = np.bincount(back, n, len(key)).astype(np.int64)
    return key // max(1, len(name)), name[key % max(1, len(name))], total


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count) of all texts; long texts are counted in windows."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    windows: list[tuple[int, np.ndarray, int]] = []
    size = 0
    for i, t in enumerate(texts):
        c = codes_of(t)
        if len(c) < 3:
            continue
        for a in range(0, len(c), BATCH_CHARS):
            windows.append((i, c[max(0, a - 2) : a + BATCH_CHARS], min(a, 2)))
            size += len(windows[-1][1])
            if size > BATCH_CHARS:
                found.append(count_windows(windows))
                windows, size = [], 0
    if windows:
        found.append(count_windows(windows))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else summed(*map(np.concatenate, zip(*found, strict=True)))  # a long text may be in several


def count_windows(windows: list[tuple[int, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count) of windows (text number, codes, how many codes at the front were in the window
    before). Codes are renumbered among those at hand, so that text and n-gram fit into one number to sort by."""
    alphabet = np.flatnonzero(np.bincount(np.concatenate([c for _, c, _ in windows])))
    rank = np.zeros(int(alphabet[-1]) + 1, np.int64)
    rank[alphabet] = np.arange(1, len(alphabet) + 1) if alphabet[0] == SPACE else np.arange(2, len(alphabet) + 2)
    bits = (len(alphabet) + 1).bit_length()
    parts, docs = [], []
    for i, c, old in windows:
        c = rank[c]
        g = grams(c, bits)
        if old:  # n-grams that lie in what was counted before
            g = np.concatenate([grams(c[old:], bits), border(c, old, bits)])
        parts.append(g)
        docs.append(np.full(len(g), i))
    doc, gram = np.concatenate(docs), np.concatenate(parts)
    if int(doc[-1]).bit_length() + 3 * bits <= 62:
        key, n = np.unique(doc << 3 * bits | gram, return_counts=True)
        doc, gram = key >> 3 * bits, key & (1 << 3 * bits) - 1
    else:
        doc, gram, n = summed(doc, gram)
    codes = np.concatenate([[0], alphabet] if alphabet[0] == SPACE else [[0, SPACE], alphabet])
    low = (1 << bits) - 1
    gram = codes[gram >> 2 * bits] << 2 * BITS | codes[gram >> bits & low] << BITS | codes[gram & low]
    return doc, gram, n  # codes ascend as their numbers do, so the order stays


def border(c: np.ndarray, a: int, bits: int) -> np.ndarray:
    """The pair and the triples that windows ending and beginning at a miss."""
    out = [int(c[a - 1]) << bits | int(c[a])]
    for s in (a - 2, a - 1):
        if s >= 0 and s + 2 < len(c) and c[s + 1] != SPACE:
            out.append(int(c[s]) << 2 * bits | int(c[s + 1]) << bits | int(c[s + 2]))
    return np.array(out, np.int64)


def ranked(doc: np.ndarray, gram: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The size most frequent n-grams of each text and their ranks from 0; ties to the smaller key."""
    order = np.lexsort((gram, -n, doc))
    doc, gram = doc[order], gram[order]
    first = np.searchsorted(doc, doc)
    rank = np.arange(len(doc)) - first
    keep = rank < size
    return doc[keep], gram[keep], rank[keep]


class Profiles:
    """Profiles of all languages, for looking up many n-grams at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        keys = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()] or [np.zeros(0, np.int64)]))
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.full((len(self.keys), len(self.langs)), size, np.int64)  # size: not in the profile
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(keys, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float | None]]:
        """The nearest language of each text (ties to the first name), how much nearer it is than the next: 1 less
        the ratio of both distances, and its distance as a part of the worst possible. und, 0 and None without a letter;
        with no languages, und, 0 and a distance of 0."""
        doc, gram, rank = ranked(*counted(texts), self.size)
        far = np.zeros((len(texts), len(self.langs)))
        seen = np.zeros(len(texts), bool)
        if len(doc):
            seen[doc] = True
            at = np.searchsorted(self.keys, gram)
            known = self.keys[at] == gram
            place = np.where(known[:, None], self.ranks[at], self.size)
            off = np.where(place == self.size, self.size, np.abs(place - rank[:, None]))
            for j in range(len(self.langs)):
                far[:, j] = np.bincount(doc, off[:, j], len(texts))
        if not self.langs:
            return [UND] * len(texts), [0.0] * len(texts), [0.0 if s else None for s in seen]
        best = far.argmin(1)
        low = far.min(1)
        second = np.partition(far, 1, axis=1)[:, 1] if len(self.langs) > 1 else np.full(len(texts), np.inf)
        score = np.where(second > 0, 1 - low / np.maximum(second, 1e-9), 0.0)
        part = low / np.maximum(self.size * np.bincount(doc, minlength=len(texts)), 1)
        return [self.langs[b] if s else UND for b, s in zip(best, seen, strict=True)], np.where(seen, score, 0.0).tolist(), [x if s else None for x, s in zip(part.tolist(), seen, strict=True)]


def train(docs: DataFrame, profile: int = PROFILE, train_docs: int = TRAIN_DOCS) -> dict[str, list[int]]:
    """Profiles of the languages in docs (text, lang; rows without either teach nothing). Counts are summed by Spark
    over at most train_docs documents of each language; the driver gets the profiles only: languages x profile rows.

    Documents are picked by the least hash of their id. A first cut by the hash, from the language's number of documents,
    leaves some 2 train_docs rows a language for the window that picks, and the picked ids are broadcast: languages x
    train_docs of them."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rank = F.shiftrightunsigned(F.xxhash64("doc_id"), 33)  # 31 bits
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    few = sizes.count() <= BROADCAST_LANGS
    near = rows.select("doc_id", "lang", rank.alias("rank")).join(F.broadcast(sizes) if few else sizes, "lang").where(F.col("rank") * F.col("n") <= F.lit(2.0 * train_docs * 2**31))
    pick = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "doc_id"))  # over some 2 train_docs rows
    ids = near.withColumn("pick", pick).where(F.col("pick") <= train_docs).select("doc_id", "lang").distinct()
    rows = rows.select("doc_id", "lang", "text").join(F.broadcast(ids) if few else ids, ["doc_id", "lang"], "left_semi").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(pc.binary_length(texts).to_pylist(), BATCH_CHARS):
                names = sorted(set(langs[a:b]))
                number = np.array([names.index(x) for x in langs[a:b]])
                doc, gram, n = counted(texts.slice(a, b - a).to_pylist())
                lang, gram, n = summed(number[doc], gram, n) if len(doc) else (doc, gram, n)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in lang.tolist()], pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    sums = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in sums.withColumn("place", place).where(F.col("place") <= profile).orderBy("lang", "place").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def identify(docs: DataFrame, profiles: dict[str, list[int]], *keep: str) -> DataFrame:
    """doc_id (or the columns in keep, whatever their names) with lang_pred, score and distance (0 to 1) of every whole
    text; columns of these names in keep stay under theirs, and the found ones are then called __lang_pred and so on.

    Null texts and texts without a letter are und with score 0 and no distance. Repeated rows stay, other columns are
    not read; an empty table gives no rows; with no profiles everything is und, and texts with letters are at distance
    0."""
    keep = keep or ("doc_id",)
    rows, text_of = rows_and_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles)
        for batch in batches:
            texts = text_of(batch)
            for a, b in slices(pc.binary_length(texts).to_pylist(), BATCH_CHARS):
                lang, score, distance = model.predict(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(distance, pa.float64())], names=["row", *FOUND])

    found = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, distance double")
    return found.select(*(F.col("row")[c].alias(c) for c in keep), *(F.col(c).alias(named(c, keep)) for c in FOUND))


FOUND = ("lang_pred", "score", "distance")


def named(column: str, keep: tuple[str, ...] | list[str]) -> str:
    return f"__{column}" if column in keep else column
