"""Toxicity by a support vector machine on a gapped string kernel with Nystroem landmarks.

The kernel of two words counts the subsequences of three letters that they share, up to GAP letters may lie between
the three, each such letter costs a factor DECAY; words begin and end with a border letter, and the sum is divided by
both words' self-weights. Inserted or lost letters so cost similarity, not recognition; characters other than letters
and digits are left out before ("m.o-r*o.n"), and single letters standing in a row are also read as one word.

Labels belong to documents. Words, and beginnings of words, whose share in toxic documents is far beyond chance name
the positive words; a text's sentences are as toxic as their worst word, and a document as its worst sentence.
Landmarks are training words; the machine is linear in the Nystroem features of the landmarks, so its weights fold
into one number for each subsequence of three letters, and scoring a word is a sum of table entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_text, rows_and_text, slices, written

GAP = 2
DECAY = 0.5
STEPS = [(a, b) for a in range(1, GAP + 2) for b in range(1, GAP + 2) if a + b <= GAP + 2]
#: At most so many labelled documents of either class are learned from, those of least hash of the id.
TRAIN_TOXIC, TRAIN_CLEAN = 3_000, 9_000
#: At most so many words of each kind go to the driver, which fits the machine.
POSITIVE_WORDS, NEGATIVE_WORDS, HARD_POOL = 1_500, 5_000, 100_000
LANDMARKS = 150  # of either side
ROUNDS = 8
RIDGE = 1e-2
PREFIXES = (4, 5, 6)
BATCH_CHARS = 1_000_000
NOTHING = -3.0  # the decision for a text without words
SPACED = re.compile(r"(?<!\S)\w(?:[ ]\w){2,}(?!\S)")


def units(text: str) -> list[str]:
    """Words of a text, in lower case, and single letters in a row as one word each."""
    text = text.lower()
    words = text.split()
    return [*words, *(m.replace(" ", "") for m in SPACED.findall(text))]


def bare(word: str) -> str:
    return word if word.isalnum() else "".join(c for c in word if c.isalnum())


class Letters:
    """Numbers of letters: 1 to n for those of an alphabet, n + 1 for all others, n + 2 and n + 3 for the borders."""

    def __init__(self, alphabet: str):
        self.n = len(alphabet)
        self.bits = max(2, (self.n + 3).bit_length())
        self.code = np.full(0x110000, self.n + 1, np.int16)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, self.n + 1)

    def prepared(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of words of about one length, between borders; 0 fills. And the lengths."""
        size = np.array([len(w) + 2 for w in words], np.int64)
        out = np.zeros((len(words), max(3, int(size.max(initial=3))) + GAP + 2), np.int64)
        at = np.arange(out.shape[1])
        out[(at > 0) & (at < size[:, None] - 1)] = self.code[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        out[:, 0] = self.n + 2
        out[np.arange(len(words)), size - 1] = self.n + 3
        return out, size

    def subsequences(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """For each way to step: the key of the subsequence that begins at each place (0 where it leaves the word)."""
        n = letters.shape[1] - GAP - 2
        for a, b in STEPS:
            x, y, z = letters[:, :n], letters[:, a : a + n], letters[:, a + b : a + b + n]
            yield np.where(z > 0, x << 2 * self.bits | y << self.bits | z, 0), DECAY ** (a + b - 2)


def self_weight(size: np.ndarray) -> np.ndarray:
    return np.sqrt(sum(np.maximum(size - a - b, 0) * DECAY ** (2 * (a + b - 2)) for a, b in STEPS) + 1e-9)


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Numbers of words of like lengths, in blocks of bounded size."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    a = 0
    while a < len(order):
        b = min(len(order), a + 20_000)
        while b > a + 1 and size[order[b - 1]] > 2 * size[order[a]] + 8:
            b = a + max(1, (b - a) // 2)
        yield order[a:b]
        a = b


def kernel_rows(letters_of: Letters, words: list[str], columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """words' subsequence sums over a table of weights: one row of weights for each of the sorted keys in columns."""
    out = np.zeros((len(words), weights.shape[1]), np.float32)
    for block in by_length(words):
        for some in np.array_split(block, max(1, len(block) // 500)):
            letters, size = letters_of.prepared([words[i] for i in some])
            total = np.zeros((len(some), weights.shape[1]))
            for key, decay in letters_of.subsequences(letters):
                at = np.minimum(np.searchsorted(columns, key), len(columns) - 1)
                hit = columns[at] == key
                row, _ = np.nonzero(hit)
                np.add.at(total, row, decay * weights[at[hit]])
            out[some] = total / self_weight(size)[:, None]
    return out


def feature_table(letters_of: Letters, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the words' subsequences and their weights in each word: keys x words."""
    found: Counter = Counter()
    for j, w in enumerate(words):
        letters, size = letters_of.prepared([w])
        scale = float(self_weight(size)[0])
        for key, decay in letters_of.subsequences(letters):
            for k in key[key > 0].tolist():
                found[k, j] += decay / scale
    columns = np.array(sorted({k for k, _ in found}), np.int64)
    weights = np.zeros((len(columns), len(words)))
    for (k, j), v in found.items():
        weights[np.searchsorted(columns, k), j] = v
    return columns, weights


def squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        inside = y * (z @ w) < 1
        a = z[inside] * cost[inside, None]
        new = np.linalg.solve(z[inside].T @ a + ridge * np.eye(len(w)), a.T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


@dataclass
class Model:
    alphabet: str = ""
    table: np.ndarray = field(default_factory=lambda: np.zeros(1 << 6, np.float32))  # a number for each subsequence key
    bias: float = -1.0
    slope: float = 1.0  # of the probability in the worst word's decision
    shift: float = 0.0

    @cached_property
    def letters(self) -> Letters:
        return Letters(self.alphabet)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "letters"}

    def decisions(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for block in by_length(words):
            letters, size = self.letters.prepared([words[i] for i in block])
            total = np.zeros(len(block))
            for key, decay in self.letters.subsequences(letters):
                total += decay * self.table[key].sum(1)
            out[block] = total / self_weight(size)
        return out + self.bias


class Scorer:
    """Decisions on words; those asked for last are kept, in two generations of at most `limit` words or so."""

    def __init__(self, model: Model, limit: int = 60_000):
        self.model, self.limit = model, limit
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def learn(self, words: set[str]) -> dict[str, float]:
        """A table that holds the words."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        old = self.old
        new = [w for w in words if w not in self.young]
        self.young.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in self.young]
        self.young.update(zip(new, self.model.decisions([bare(w) for w in new]).tolist(), strict=True))
        return self.young

    def worst(self, texts: list[str]) -> np.ndarray:
        """The decision on the worst word of each text."""
        lists = [units(t) for t in texts]
        get = self.learn(set().union(*lists)).__getitem__
        return np.array([max(map(get, x), default=NOTHING) for x in lists])


def fit_machine(positive: dict[str, int], negative: dict[str, int], pool: list[str]) -> Model:
    """The machine, fitted on words with the numbers of documents that hold them.

    Landmarks are the commonest positive words and the hardest negative ones: words of clean documents nearest to the
    positive side join the negatives, round after round.
    """
    if not positive:
        return Model()
    likely = sorted(positive, key=lambda w: (-positive[w], w))
    hard: list[str] = []
    negatives = list(negative) or ["-"]
    for _ in range(ROUNDS):
        landmarks = [*likely[:LANDMARKS], *hard[:LANDMARKS]] if hard else [*likely[:LANDMARKS], *negatives[: LANDMARKS // 4]]
        letters = Letters(alphabet := "".join(sorted(set("".join(landmarks)))))
        columns, weights = feature_table(letters, landmarks)
        value, vector = np.linalg.eigh(weights.T @ weights)
        keep = value > 1e-5 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        words = [*likely, *negatives, *hard]
        y = np.array([1.0] * len(likely) + [-1.0] * (len(words) - len(likely)))
        z = np.column_stack([kernel_rows(letters, words, columns, weights @ root), np.ones(len(words))])
        often = np.sqrt([positive.get(w) or 1 for w in words])
        cost = np.where(y > 0, often / often[y > 0].mean(), 1.0) * np.where(y > 0, len(y) / 4 / len(likely), 1.0)
        w = squared_hinge(z, y, cost, RIDGE)
        table = np.zeros(1 << 3 * letters.bits, np.float32)
        table[columns] = weights @ (root @ w[:-1])
        model = Model(alphabet, table, float(w[-1]))
        if not pool:
            break
        order = np.argsort(-(d := model.decisions(pool)))[:400]
        new = [pool[i] for i in order if d[i] > -0.7]
        if not set(new).difference(hard):
            break
        hard = list(dict.fromkeys([*new, *hard]))
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a slightly regularised logistic curve."""
    w = np.zeros(2)
    z = np.column_stack([x, np.ones(len(x))])
    cost = np.full(len(x), 1 / max(1, len(x)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (cost * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2), z.T @ (cost * (y - p)) - 1e-4 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic 0 or 1); null texts and labels teach nothing.

    Of several labels of a document toxic counts; repeated documents teach as often as they stand there. Without toxic
    or without clean documents the model calls nothing toxic.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    top = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    picked = top[0].unionByName(top[1])
    texts = docs.where("text is not null").select("doc_id", "text").join(picked, "doc_id").select("text", "toxic")

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {b for w in units(text) if (b := bare(w))}
                seen[toxic].update(f"={w}" for w in words)
                seen[toxic].update({f"^{w[:n]}" for w in words for n in PREFIXES if len(w) >= n})
                seen[toxic].update((f"#{toxic}",))
            names = list(set(seen[0]) | set(seen[1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][k] for k in names], pa.int64()), pa.array([seen[0][k] for k in names], pa.int64())], names=["item", "toxic", "clean"])

    counts = written(texts.mapInArrow(items, "item string, toxic long, clean long").groupBy("item").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-items")
    sums = {r["item"]: r["toxic"] + r["clean"] for r in counts.where("item in ('#0', '#1')").collect()}
    n_toxic, n_clean = sums.get("#1", 0), sums.get("#0", 0)
    if not n_toxic or not n_clean:
        return Model()
    share = n_toxic / (n_toxic + n_clean)
    found = counts.where(~F.col("item").startswith("#"))
    # The chance that a word of this frequency has no clean documents, or few: far below one word of all
    sure = found.where((F.col("toxic") >= 4) & (F.col("clean") * 50 <= F.col("toxic")) & (F.col("toxic") * float(-np.log(share)) >= 10 + 4 * F.col("clean")))
    sure = [r["item"] for r in sure.orderBy(F.desc("toxic"), "item").limit(POSITIVE_WORDS).collect()]
    words = found.where(F.col("item").startswith("=")).select(F.substring("item", 2, 1 << 20).alias("word"), "toxic", "clean")
    sign = F.col("word").isin([i[1:] for i in sure if i[0] == "="])
    for n in PREFIXES:
        if some := [i[1:] for i in sure if i[0] == "^" and len(i) == n + 1]:
            sign = sign | F.left("word", F.lit(n)).isin(some)
    positive = {r["word"]: r["toxic"] for r in words.where((F.col("toxic") > 0) & (F.col("clean") == 0) & sign).orderBy(F.desc("toxic"), "word").limit(POSITIVE_WORDS).collect()}
    clean = {r["word"]: r["clean"] for r in words.where((F.col("clean") > 0) & ~sign & (F.length("word") <= 40)).orderBy(F.xxhash64("word")).limit(HARD_POOL).collect()}
    model = fit_machine(positive, dict(list(clean.items())[:NEGATIVE_WORDS]), list(clean))
    scored = written(decisions(texts.withColumn("doc_id", F.lit(0)), model, "toxic"), "toxicity-decisions").collect()  # TRAIN_* rows
    model.slope, model.shift = logistic(np.array([r["__decision"] for r in scored]), np.array([r["toxic"] for r in scored]))
    return model


def decisions(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id (or the columns in keep, whatever their names) and __decision, the worst word's, of every whole text."""
    keep = keep or ("doc_id",)
    rows, text_of = rows_and_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = text_of(batch)
            for a, b in slices(pc.binary_length(texts).to_pylist(), BATCH_CHARS):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scorer.worst(texts.slice(a, b - a).to_pylist()))], names=["row", "decision"])

    found = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, decision double")
    return found.select(*(F.col("row")[c].alias(c) for c in keep), F.col("decision").alias("__decision"))


def toxic(model: Model, decision: str = "__decision"):
    """The probability of a decision, as a Column."""
    return 1 / (1 + F.exp(-(F.lit(model.slope) * F.col(decision) + F.lit(model.shift))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 where score >= 0.5) of every whole text.

    Null and empty texts, and texts without words, get the score of no word at all; repeated rows stay; other columns
    are not read; an empty table gives no rows.
    """
    out = decisions(docs_text(docs), model).select("doc_id", toxic(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
