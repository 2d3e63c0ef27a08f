"""Records that are the same but for white space, letter case, punctuation or the order of their fields.

Two texts are copies if they have the same words in the same order before the first `?` and equally often the same
fields, in any order, after it. Words are unbroken runs of letters and digits, in any case; fields are parted by `&` or
`;`, and those without words don't count.

A table over all code points says of each character whether it is skipped or what it folds to. The characters of a batch
go through it as one array into polynomial hashes (one for the path, one for each field, the latter added up, so that
their order doesn't matter); canonical strings are never built. Each text is hashed once, into a narrow table of ids and
hashes, over which groups are found. Only texts of groups of two or more are fetched. Each is then compared with the first
record of its group by two positions that advance together and skip what doesn't count; rows that only share the hashes
are grouped anew by their exact words.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from waymark.storage import materialise

_CHUNK = 2_000_000  # characters handled at once
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_AMP, _SEMI, _ASK = ord("&"), ord(";"), ord("?")


@functools.lru_cache(1)
def fold_table() -> np.ndarray:
    """For each code point what it folds to; 0: it is skipped."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalnum():
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Symbols:
    """Some texts as one array of characters: what each folds to, and the runs of one path or one field each."""

    def __init__(self, texts: list[str]):
        self.n = n = len(texts)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        row = np.repeat(np.arange(n), sizes)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(codes)) - starts[row]
        ask = sizes.copy()  # of the first question mark of each row
        marks = np.flatnonzero(codes == _ASK)
        np.minimum.at(ask, row[marks], place[marks])
        ask = ask[row]
        in_query = place > ask
        opens = (place == 0) | (place == ask) | (in_query & ((codes == _AMP) | (codes == _SEMI)))
        run = np.cumsum(opens) - 1
        self.kept = fold_table()[codes]
        keep = self.kept > 0
        self.begins = keep.copy()  # a word
        if len(codes):
            self.begins[1:] &= ~keep[:-1] | opens[1:]
        at = np.flatnonzero(keep)
        _, first = np.unique(run[at], return_index=True)
        self.head = at[first]  # of each run that has any kept character: its first, and the one behind its last
        self.end = at[np.append(first[1:], len(at)) - 1] + 1 if len(at) else self.head
        self.row, self.is_field = row[self.head], in_query[self.head]
        count = np.diff(np.append(first, len(at)))
        words = np.cumsum(self.begins[at])
        # a word's end takes a place of its own
        spot = np.arange(len(at)) - np.repeat(first, count) + words - np.repeat(words[first], count)
        self.hashes = [self._hash(base, at, first, spot) for base in _BASES]

    def _hash(self, base: np.uint64, at: np.ndarray, first: np.ndarray, spot: np.ndarray) -> np.ndarray:
        """The polynomial hash of each run."""
        if not len(at):
            return np.zeros(0, np.uint64)
        powers = np.multiply.accumulate(np.full(int(spot.max()) + 1, base, np.uint64))
        return np.add.reduceat(_mix(self.kept[at].astype(np.uint64) * base) * powers[spot], first)

    def row_hashes(self) -> list[np.ndarray]:
        out = []
        for k, h in enumerate(self.hashes):
            mixed = np.where(self.is_field, _mix(h + np.uint64(0x5851F42D4C957F2D + k)), _mix(h) * np.uint64(3))
            total = np.zeros(self.n, np.uint64)
            np.add.at(total, self.row, mixed)
            out.append(total.view(np.int64))
        return out

    def ordered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the number of its first run and how many it has, the path before the fields and these by their hashes;
        and for each character the next kept one."""
        order = np.lexsort((self.hashes[1], self.hashes[0], self.is_field, self.row))
        n_runs = np.bincount(self.row, minlength=self.n)
        following = np.where(self.kept > 0, np.arange(len(self.kept)), len(self.kept))
        following = np.append(np.minimum.accumulate(following[::-1])[::-1], len(self.kept))
        return order, np.cumsum(n_runs) - n_runs, n_runs, following


def exact_key(text: str) -> str:
    """The words of the path and the sorted fields. Only for rows whose hashes collide, and for tests."""
    table = fold_table()

    def words(part: str) -> str:
        return " ".join("".join(chr(k) if (k := table[ord(c)]) else " " for c in part).split())

    path, _, query = text.partition("?")
    fields = sorted(w for f in query.replace(";", "&").split("&") if (w := words(f)))
    return "\n".join([words(path), *fields])


def _chunks(sizes: list[int]):
    begin = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > _CHUNK:
            yield begin, i
            begin, total = i, 0
        total += size
    yield begin, len(sizes)


def hash_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [Symbols(texts[a:b]).row_hashes() for a, b in _chunks([len(t) for t in texts])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def same_texts(left: list[str], right: list[str]) -> np.ndarray:
    """Of each pair, whether they are copies.

    Two positions a pair advance together from kept character to kept character, all pairs of a chunk at once, through the
    path and then the fields in the order of their hashes. Where they meet a difference (fields of equal hashes may stand in
    another order), exact words decide."""
    out = np.zeros(len(left), bool)
    for a, b in _chunks([len(x) + len(y) for x, y in zip(left, right, strict=True)]):
        x, y = Symbols(left[a:b]), Symbols(right[a:b])
        (order_x, first_x, runs_x, next_x), (order_y, first_y, runs_y, next_y) = x.ordered(), y.ordered()
        same = runs_x == runs_y
        for k in range(int(runs_x[same].max()) if same.any() else 0):
            live = np.flatnonzero(same & (runs_x > k))
            run_x, run_y = order_x[first_x[live] + k], order_y[first_y[live] + k]
            same[live[x.is_field[run_x] != y.is_field[run_y]]] = False
            i, j, end_i, end_j = x.head[run_x], y.head[run_y], x.end[run_x], y.end[run_y]
            while len(live):
                good = same[live] & (x.kept[i] == y.kept[j]) & (x.begins[i] == y.begins[j])
                i, j = next_x[i + 1], next_y[j + 1]
                over_i, over_j = i >= end_i, j >= end_j
                good &= over_i == over_j
                same[live[~good]] = False
                on = good & ~over_i
                live, i, j, end_i, end_j = live[on], i[on], j[on], end_i[on], end_j[on]
        for i in np.flatnonzero(~same):
            same[i] = exact_key(left[a + i]) == exact_key(right[a + i])
        out[a:b] = same
    return out


@F.pandas_udf(StructType().add("h1", LongType()).add("h2", LongType()))
def _hashes(texts: pd.Series) -> pd.DataFrame:
    h1, h2 = hash_texts(list(texts))
    return pd.DataFrame({"h1": h1, "h2": h2})


_hashes = _hashes.asNondeterministic()  # so that no filter on the result repeats it


@F.pandas_udf(StringType())
def _key_if_apart(texts: pd.Series, firsts: pd.Series) -> pd.Series:
    """Null where the text is a copy of the first record's (firsts is null where both are equal as they stand)."""
    out = np.full(len(texts), None, object)
    rows = np.flatnonzero(firsts.notna().to_numpy())
    left, right = texts.to_numpy(object)[rows], firsts.to_numpy(object)[rows]
    for i in rows[~same_texts(list(left), list(right))] if len(rows) else ():
        out[i] = exact_key(texts.iloc[i])
    return pd.Series(out)


def format_groups(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """first_id, copy_id: each record that is a copy of one with a smaller id, and the smallest id of its group.

    Null texts are no records; texts without any word (empty ones too) are copies of each other. Rows that repeat an id
    with the same text are one record, those that repeat it with another text are records of their own. Other columns
    don't matter. A group of any size is met with partial aggregation and joins whose skewed partitions adaptive execution
    splits; no task holds a group."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where("_id is not null and _text is not null")
    narrow = materialise(rows.select("_id", F.xxhash64("_text").alias("_x"), _hashes("_text").alias("_h")).select("_id", "_x", "_h.h1", "_h.h2"), "hashes")
    groups = narrow.groupBy("h1", "h2").agg(F.min("_id").alias("first_id"), F.max("_id").alias("_last")).where("first_id < _last").drop("_last")
    members = narrow.join(groups, ["h1", "h2"]).groupBy("_id", "_x", "h1", "h2").agg(F.min("first_id").alias("first_id"))
    texts = materialise(rows.withColumn("_x", F.xxhash64("_text")).join(members, ["_id", "_x"]).drop("_x"), "texts")
    firsts = texts.where("_id = first_id").groupBy("h1", "h2").agg(F.min("_text").alias("_first"))
    compared = texts.where("_id <> first_id").join(firsts, ["h1", "h2"])
    key = _key_if_apart("_text", F.when(F.col("_text") != F.col("_first"), F.col("_first")))
    checked = materialise(compared.select("first_id", "_id", key.alias("_key")), "copies")
    apart = checked.where("_key is not null").select("_id", "_key")
    anew = apart.groupBy("_key").agg(F.min("_id").alias("first_id"), F.max("_id").alias("_last")).where("first_id < _last").drop("_last")
    rest = apart.join(anew, "_key").where("_id <> first_id").select("first_id", "_id")
    copies = checked.where("_key is null").select("first_id", "_id").unionByName(rest)
    return copies.distinct().select("first_id", F.col("_id").alias("copy_id"))


def collapse_formats(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row a group: first_id and n_copies (records in it, the first included; 1 where there is no copy)."""
    copies = materialise(format_groups(df, id_col, text), "copies")
    counts = copies.groupBy("first_id").agg((F.count(F.lit(1)) + 1).alias("n_copies"))
    ids = df.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("first_id")).distinct()
    firsts = ids.join(copies.select(F.col("copy_id").alias("first_id")), "first_id", "left_anti")
    return firsts.join(counts, "first_id", "left").select("first_id", F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))
