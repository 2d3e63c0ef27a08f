"""Byte-level BPE of whole texts, with the ids of a public tokenizer.

Speculate and verify: greedy longest match proposes the tokens of each distinct word; then every pair of adjacent tokens
is tested, all pairs of a batch at once, for whether exact merging of the two tokens' bytes would leave exactly the two.
A sequence of tokens is the exact encoding if and only if all its adjacent pairs pass. Only words with a failing pair go
through exact merging (by a heap, so that a word of a megabyte costs n log n).

Null and empty texts have no ids (an empty list). Special tokens are never produced: their strings are ordinary text.
"""

from __future__ import annotations

import functools
import heapq
import json
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

#: Fixed value: how the public tokenizer cuts text into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KEPT_WORDS = 400_000
_NEVER = np.iinfo(np.int64).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in vocabulary files: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Merge tables of one vocabulary: some megabytes, whatever the size of the corpus."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        letters = _byte_letters()
        self.size = max(vocabulary.values()) + 1
        self.byte_ids = [vocabulary[c] for c in sorted(letters, key=letters.get)]
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, -1, np.int64)  # bytes were there before every merge
        self.pairs: dict[tuple[int, int], int] = {}
        text = {i: t for t, i in vocabulary.items()}
        for rank, (a, b) in enumerate(merges):
            new = vocabulary[a + b]
            self.pairs[vocabulary[a], vocabulary[b]] = new
            if self.rank[new] < 0:
                self.left[new], self.right[new], self.rank[new] = vocabulary[a], vocabulary[b], rank
        keys = np.array([a * self.size + b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(list(self.pairs.values()), np.int64)[order]
        self.merge_rank = self.rank[self.merged]
        reachable = [i for i in text if self.rank[i] >= 0 or i in set(self.byte_ids)]
        spelled = {i: bytes(letters[c] for c in text[i]) for i in reachable}
        self.by_bytes = {s: i for i, s in spelled.items()}
        whole = [i for i in spelled if self.rank[i] >= 0 and self.merge_exactly(spelled[i]) != [i]]
        for i in whole:  # a token that merging never leaves standing alone is never proposed
            del self.by_bytes[spelled[i]]
        self.longest = max(map(len, self.by_bytes))

    def merge_exactly(self, word: bytes) -> list[int]:
        """All merges by rank, of equal ranks from left to right."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (new := self.pairs.get((ids[i], ids[j]))) is not None:
                heap.append((self.rank[new], i, ids[i], ids[j], new)) if not started else heapq.heappush(heap, (self.rank[new], i, ids[i], ids[j], new))

        started = False
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        started = True
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in ids if t >= 0]

    def guess(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        if (whole := self.by_bytes.get(word)) is not None:
            return [whole]
        out, at, end, find = [], 0, len(word), self.by_bytes.get
        while at < end:
            stop = min(end, at + self.longest)
            while (token := find(word[at:stop])) is None:
                stop -= 1
            out.append(token)
            at = stop
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of adjacent tokens, whether exact merging of their bytes leaves exactly these two.

        Merging is followed backwards from the two tokens: of the two the one made last is taken apart, and the pair that
        then meets at the seam must not have a merge of its own that would have come before."""
        a, b = a.copy(), b.copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), _NEVER)  # a merge at the seam counts if its rank is below
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            broken = (self.keys[at] == key) & (self.merge_rank[at] < top)
            good[live[broken]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            go = ~broken & ((rank_x >= 0) | (rank_y >= 0))
            left_last = rank_x > rank_y
            # made last: it stood as its parts until its own merge; of equal ranks the one further left merges first
            new_x, new_y = np.where(left_last, self.right[x], x), np.where(left_last, y, self.left[y])
            top = np.where(left_last, rank_x, rank_y + 1)
            a[live], b[live], limit[live] = new_x, new_y, top
            live = live[go]
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        guesses = [self.guess(w) for w in words]
        sizes = np.array([len(g) for g in guesses], np.int64)
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        seam = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        distinct, back = np.unique(flat[seam] * self.size + flat[seam + 1], return_inverse=True)
        good = self.compatible(distinct // self.size, distinct % self.size)
        for i in np.unique(owner[seam[~good[back]]]):
            guesses[i] = self.merge_exactly(words[i])
        return guesses


@functools.lru_cache(4)
def load(path: str) -> Bpe:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return Bpe(model["vocab"], merges)


class Encoder:
    """Encodes batches; distinct words that came before are remembered, up to a bound."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.words, self.sizes, self.cut = bpe, {}, {}, regex.compile(WORDS)

    def _cut(self, texts: list[str | None]):
        """The words of each text, all of them known by then."""
        for begin in range(0, len(texts), 256):
            cut = [self.cut.findall(t) if t else [] for t in texts[begin : begin + 256]]
            words = set(chain.from_iterable(cut))
            fresh = list(words - self.words.keys())
            if len(self.words) + len(fresh) > _KEPT_WORDS:
                self.words, self.sizes, fresh = {}, {}, list(words)
            found = self.bpe.encode_words([w.encode() for w in fresh])
            self.words.update(zip(fresh, found, strict=True))
            self.sizes.update(zip(fresh, map(len, found), strict=True))
            yield from cut

    def encode(self, texts: list[str | None]):
        for each in self._cut(texts):
            yield list(chain.from_iterable(map(self.words.__getitem__, each)))

    def count(self, texts: list[str | None]):
        for each in self._cut(texts):
            yield sum(map(self.sizes.__getitem__, each))


_ENCODERS: dict[int, tuple] = {}


def _encoder(shipped) -> Encoder:
    """One encoder a worker process and vocabulary."""
    key = id(shipped)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = shipped, Encoder(shipped.value)
    return _ENCODERS[key][1]


def token_ids(spark: SparkSession, text: Column, vocabulary: str | None = None) -> Column:
    """The ids of text as array<int>. The vocabulary file is read by the driver only and shipped to the executors.

    Called non-deterministic, as all Python functions here, so that a filter on the result doesn't repeat it."""
    shipped = spark.sparkContext.broadcast(load(vocabulary or default_vocabulary()))

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(x, np.int32) for x in _encoder(shipped).encode(texts.tolist())], dtype=object)

    return ids.asNondeterministic()(F.coalesce(text, F.lit("")))


def token_count(spark: SparkSession, text: Column, vocabulary: str | None = None) -> Column:
    """How many ids text has; 0 for null."""
    shipped = spark.sparkContext.broadcast(load(vocabulary or default_vocabulary()))

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_encoder(shipped).count(texts.tolist())), dtype="int64")

    return count.asNondeterministic()(F.coalesce(text, F.lit("")))
