"""Token ids of whole texts by a public tokenizer file, with each distinct word encoded once."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of Latin letters, with at most a comma or full stop behind.
PLAIN = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+[,.]?$"


class Cache:
    """The last words asked for and their ids, in two generations of at most `limit` words or so: when the young one
    is full, it takes the place of the old one, and words that are asked for again move back."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 60_000):
        self.encode, self.limit = encode, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, words: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        new = [w for w in words if w not in young]
        for w in new:
            if w in old:
                young[w] = old[w]
        new = [w for w in new if w not in young]
        young.update(zip(new, self.encode(new), strict=True))
        out = [young[w] for w in words]
        if len(young) > self.limit:
            self.young, self.old = {}, young
        return out


class Pieces:
    """Runs of ids side by side: ids[start[i] : start[i] + size[i]]."""

    def __init__(self, ids: np.ndarray, size: np.ndarray):
        self.ids, self.size = ids, size
        self.start = np.cumsum(size) - size

    def take(self, index: np.ndarray) -> Pieces:
        size = self.size[index]
        end = np.cumsum(size)
        at = np.repeat(self.start[index] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        return Pieces(self.ids[at], size)


class TokenIds:
    """The tokenizer drops white space and never joins what ASCII white space parts, so a text's ids are its words'
    ids. Words are parted and told apart by Arrow; each distinct word of a batch is encoded by the tokenizers library,
    unless a bounded cache has it.

    Words of Latin letters, with at most a comma or full stop behind, are lower-cased and parted before, as the
    tokenizer would do; the letters, one token run each, are then encoded many in a string, and the marks of word ends
    in the vocabulary tell the runs apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks = self.pieces(self.encode_strings([",", "."]))
        self.letters, self.others = Cache(self.encode_letters), Cache(self.encode_strings)

    def pieces(self, blobs: list[bytes]) -> Pieces:
        return Pieces(np.frombuffer(b"".join(blobs), self.dtype), np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.dtype.itemsize)

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for a in range(0, len(strings), 5000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(strings[a : a + 5000], add_special_tokens=False)]
            out += [np.array(x, self.dtype).tobytes() for x in ids]
        return out

    def encode_letters(self, words: list[str]) -> list[bytes]:
        """Lower-case words of letters alone."""
        out: list[bytes] = []
        for a in range(0, len(words), 20_000):
            some = words[a : a + 20_000]
            encoded = self.tokenizer.encode_batch_fast([" ".join(some[i : i + 100]) for i in range(0, len(some), 100)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, self.dtype) for e in encoded])
            ends = ((np.nonzero(self.ends[ids])[0] + 1) * self.dtype.itemsize).tolist()
            flat = ids.tobytes()
            if len(ends) == len(some) and ends[-1] == len(flat):
                out += [flat[x:y] for x, y in zip([0, *ends], ends, strict=False)]
            else:
                out += self.encode_strings(some)
        return out

    def encode_words(self, words: pa.Array) -> Pieces:
        """Ids of distinct words."""
        plain = pc.match_substring_regex(words, PLAIN)
        whole = words.filter(plain)
        parted = pc.utf8_lower(pc.utf8_rtrim(whole, ",.")).dictionary_encode()
        cores = self.pieces(self.letters(parted.dictionary.to_pylist()))
        others = self.pieces(self.others(words.filter(pc.invert(plain)).to_pylist()))
        # every word is two runs: its letters, or all of it, and its mark or nothing
        runs = np.concatenate([cores.ids, others.ids, self.marks.ids])
        size = np.concatenate([cores.size, others.size, self.marks.size, [0]])
        first = np.empty(len(words), np.int64)
        second = np.full(len(words), len(size) - 1)
        plain = np.asarray(plain)
        first[plain] = np.asarray(parted.indices)
        first[~plain] = len(cores.size) + np.arange(len(others.size))
        base = len(cores.size) + len(others.size)
        comma, stop = (np.asarray(pc.ends_with(whole, m)) for m in ",.")
        second[plain] = np.where(comma, base, np.where(stop, base + 1, len(size) - 1))
        both = Pieces(runs, size).take(np.column_stack([first, second]).ravel())
        return Pieces(both.ids, both.size.reshape(-1, 2).sum(1))

    def encode(self, texts: pa.Array) -> Pieces:
        """Ids of texts without nulls."""
        parted = pc.ascii_split_whitespace(texts)
        words = parted.flatten().dictionary_encode()
        found = self.encode_words(words.dictionary).take(np.asarray(words.indices))
        ends = np.concatenate([[0], np.cumsum(found.size)])[np.asarray(parted.offsets) - parted.offsets[0].as_py()]
        return Pieces(found.ids, np.diff(ends))


@lru_cache(2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)
