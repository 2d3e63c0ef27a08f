"""Mixing sources to target shares of tokens.

The wanted tokens of each source follow from the shares and the total; a source that can't give them even at its largest
number of repeats gives all it can, and the others share what is left in proportion to their targets. Every document of a
source then has the same expected number of copies: a whole part, and a fraction that is an inclusion probability.

Fractions are turned into zeros and ones by the cube method. The flight phase moves probabilities along the null space of
the balancing equations (number of documents, number of tokens) until one of them is 0 or 1. It runs in blocks of BLOCK
documents of a source, in rounds over all triples of neighbours in size at once; each block leaves two fractions at most,
which fly again in blocks, until one block a source is left. The landing takes, for the one or two that are left then, the
ends that miss the source's tokens by least: less than half of a document's.

Documents that weigh more than GIANT of their block move first, against all others of the block instead of two. That
changes neither probabilities nor totals: every move, of either kind, is along a vector that both equations map to zero,
so both totals stay; and its two ends are drawn with chances in inverse proportion to their distances, so that each
probability is in expectation what it was (up to the landing). The two kinds differ only in how much is left for it. Nor does the cut
into blocks matter to either, as each block's totals stay by themselves.

Documents of other sources or of none, and documents without tokens (null and empty texts), take no part. Rows that repeat
a doc_id are documents of their own. Null shares count as 0, null repeats as 1.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from waymark.llm.tokens import token_count
from waymark.storage import materialise

BLOCK = 5_000
GIANT = 0.002
_EDGE = 1e-9


def expected_copies(sizes: dict[str, int], targets: Iterable[tuple[str, float | None, int | None]]) -> dict[str, float]:
    """Expected copies of each document, by source. A row a source: this runs on the driver."""
    rows = {s: (float(share or 0), int(1 if most is None else most)) for s, share, most in targets if s is not None}
    total = sum(sizes.get(s, 0) for s in rows)
    left, open_, copies = float(total), {s for s in rows if sizes.get(s, 0) > 0 and rows[s][0] > 0}, dict.fromkeys(rows, 0.0)
    while open_:
        weight = sum(rows[s][0] for s in open_)
        full = {s for s in open_ if left * rows[s][0] / weight >= rows[s][1] * sizes[s]}
        for s in full or open_:
            copies[s] = float(rows[s][1]) if full else left * rows[s][0] / weight / sizes[s]
        left -= sum(rows[s][1] * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    return copies


def _step(chance: np.ndarray, way: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """chance after a move along way, a row a move: to the end of either direction, in expectation nowhere."""
    with np.errstate(divide="ignore", invalid="ignore"):
        above, below = (1 - chance) / np.abs(way), chance / np.abs(way)
    above, below = np.where(way == 0, np.inf, above), np.where(way == 0, np.inf, below)
    up, down = np.where(way > 0, above, below).min(1), np.where(way > 0, below, above).min(1)
    out = chance + np.where(draw.random(len(chance)) * (up + down) < down, up, -down)[:, None] * way
    return np.where(out < _EDGE, 0.0, np.where(out > 1 - _EDGE, 1.0, out))


def settle_giants(chance: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Decide the units of over GIANT of the block's size first (at most 1 / GIANT), each against all others at once.

    Between two neighbours a unit far larger than they are would hardly move. Here it moves at full pace along a null vector
    that spreads what balances it evenly over the block."""
    out = chance.copy()
    flying = (out > 0) & (out < 1)
    for k in np.flatnonzero(flying & (size > GIANT * size[flying].sum())):
        while 0 < out[k] < 1:
            rest = (out > 0) & (out < 1)
            rest[k] = False
            t = size[rest]
            spread = t.var() if len(t) > 1 else 0.0
            if not spread:
                break
            slope = -(size[k] - t.mean()) / (len(t) * spread)
            way = np.zeros(len(out))
            way[k], way[rest] = 1.0, -1.0 / len(t) + slope * (t - t.mean())
            way[np.abs(way) < 1e-15] = 0.0
            out = _step(out[None], way[None], draw)[0]
    return out


def fly(chance: np.ndarray, size: np.ndarray, draw: np.random.Generator, land: bool) -> np.ndarray:
    """The flight over one block; with land, also the landing."""
    out = settle_giants(np.asarray(chance, float), np.asarray(size, float), draw)
    size = np.asarray(size, float)

    def open_() -> np.ndarray:
        return np.flatnonzero((out > 0) & (out < 1))

    while len(left := open_()) > 2:
        units = left[: len(left) // 3 * 3].reshape(-1, 3)
        a, b, c = size[units].T
        way = np.stack([c - b, a - c, b - a], 1)
        way[(a == b) & (b == c)] = [1.0, -1.0, 0.0]
        out[units] = _step(out[units], way / np.abs(way).max(1, keepdims=True), draw)
    if len(left) == 2 and size[left[0]] == size[left[1]]:
        out[left] = _step(out[left][None], np.array([[1.0, -1.0]]), draw)[0]
    if land and len(left := open_()):
        ends = np.array(list(itertools.product((0.0, 1.0), repeat=len(left))))
        miss = np.abs((ends - out[left]) @ size[left])
        out[left] = ends[draw.choice(np.flatnonzero(miss == miss.min()))]
    return out


def _flight(land: bool, seed: int):
    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # the largest fly first, so that what is left for the landing is small
        rows = rows.sort_values(["n_tokens", "order", "doc_id"], ascending=[False, True, True], kind="stable")
        draw = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode()), int(key[1])])
        chance = fly(rows["chance"].to_numpy(float), rows["n_tokens"].to_numpy(float), draw, land)
        return rows.assign(chance=chance)

    return block


def mixed(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """doc_id, source, n_tokens and copies (1 or more) of each document of the mix."""
    spark = documents.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
    rows = documents.select("doc_id", "source", "text").where("text is not null").join(wanted.select("source"), "source", "left_semi")
    sized = materialise(rows.select("doc_id", "source", token_count(spark, F.col("text"), vocabulary).alias("n_tokens")).where("n_tokens > 0"), "sizes")
    stats = {r.source: r for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    copies = expected_copies({s: int(r.tokens) for s, r in stats.items()}, [tuple(r) for r in wanted.collect()])
    plan = [(s, int(c + _EDGE), max(0.0, c - int(c + _EDGE)) if c - int(c + _EDGE) > _EDGE else 0.0) for s, c in copies.items()]
    shares = spark.createDataFrame(plan or [("", 0, 0.0)], "source string, whole int, chance double")
    units = sized.join(F.broadcast(shares), "source")  # a row a source
    units = units.select("doc_id", "source", "n_tokens", "whole", "chance", F.xxhash64(F.lit(seed), "doc_id", "n_tokens").alias("order"))

    done, flying = [units.where("chance = 0")], units.where("chance > 0")
    counts = {s: r.n for s, r in stats.items()}
    flown_schema = StructType([*units.schema.fields, StructField("block", LongType())])
    while True:
        blocks = {s: max(1, math.ceil(n / block)) for s, n in counts.items()}
        last = max(blocks.values(), default=1) == 1
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), F.col("source")), F.lit(1)) if blocks else F.lit(1)
        grouped = flying.withColumn("block", F.pmod("order", parts)).groupBy("source", "block")
        flown = materialise(grouped.applyInPandas(_flight(last, seed), flown_schema).drop("block"), "flight")
        decided = flown.where("chance = 0 or chance = 1") if not last else flown
        done.append(decided)
        if last:
            break
        flying = flown.where("chance > 0 and chance < 1").withColumn("order", F.xxhash64("order"))
        counts = {r.source: r.n for r in flying.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("chance").cast("int")).alias("copies")).where("copies > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each source its target and actual share of the tokens, and what it gives: documents, copies, tokens."""
    given = mix.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"),
    )
    total = given.agg(F.sum("n_tokens").alias("_total"))
    rows = targets.where("source is not null").join(given, "source", "left").join(F.broadcast(total))  # one row
    share = F.coalesce(F.col("n_tokens") / F.col("_total"), F.lit(0.0))
    whole = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_documents", "n_copies", "most_copies", "n_tokens")]
    return rows.select("source", "target_share", share.alias("actual_share"), "max_repeats", *whole)
