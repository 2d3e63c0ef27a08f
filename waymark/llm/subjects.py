"""Subject areas of documents: labelling functions, their accuracies, and posterior probabilities.

A document is about an area if its speaker gives it at least three sentences. Four labelling functions vote on each
document and area:

* lexicon: how many sentences of the speaker name the area. Its terms (words, pairs of words and whole sentences) are
  first taken from the descriptions of the areas and a labelled sample, then grown over the whole corpus: every document
  that these terms give an area to, or that is labelled, counts for the terms it holds. A term belongs to an area if the
  documents that hold it are about the area so often that the lower bound of that share (Wilson, one-sided) exceeds
  MIN_SHARE. A sentence goes to the area of its surest term. Whole sentences that are frequent without belonging to any
  area (formulas, figures of speech) silence their own words.
* address: what the lexicon says of the other documents at the same address, by default the same speech of the same
  sitting: reissues and other records of it.
* section: whether the documents of this agenda item are about the area more or less often than others.
* source: the same for the source.

What each vote is worth isn't set but learned: a latent model (each function's votes depend on whether the document is
about the area) is fitted by expectation maximisation to the counts of all vote patterns of the whole corpus, beginning
from what the votes mean on a tenth of the labelled documents that take no part in the lexicon. A function that doesn't
vote says nothing. A document, labelled or not, gets the areas whose posterior is at least one half.

Interruptions by others (in brackets of either kind, or behind "An Hon. Member:") are cut out before sentences are. Null,
empty and blank texts have no sentences and no areas. Labels of documents that don't exist, or of areas that aren't
listed, are ignored; the label `none` says that a document has no area. Rows that repeat a doc_id are judged as one
document whose sentences are those of all rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from waymark.storage import materialise

#: At most about so many labelled documents fit the first lexicon (chosen by a hash of their id).
MAX_LABELLED = 50_000
#: A grown lexicon holds at most so many terms, those of the most documents first: it is sent to all executors.
MAX_TERMS = 200_000
SEED_DOCUMENTS, SEED_SHARE = 2, 0.3
MIN_DOCUMENTS, MIN_SHARE, Z = 4, 0.4, 1.64
MIN_FORMULA = 10
SENTENCES = 3
LABEL_WEIGHT = 0.1
HELD_OUT = 10  # one of so many labelled documents
_BINS = (6, 3, 3, 3)  # votes of lexicon, address, section, source
_VOTES = (6, 3, 9)  # section and source go together (both with the language, say): the model takes them as one function
_SILENT = (-1, 1, 4)  # the vote of each that is none
_KEPT_TERMS = 400_000  # that a task holds before it hands them on

#: An interruption in brackets: of any length within a paragraph, of at most 400 characters beyond it.
_ASIDE = re.compile(r"\((?:[^()\n]*|[^()]{0,400})\)|\[(?:[^\[\]\n]*|[^\[\]]{0,400})\]|\bAn? Hon\. Members?: [^.!?\n]*[.!?]?")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_ENDS = re.compile(r"(?<=[.!?])[\"'”’»]*\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of the speaker, in lower case."""
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    n = 1
    while n and ("(" in text or "[" in text or "Hon. Member" in text):  # also brackets within brackets
        text, n = _ASIDE.subn(" ", text)
    return [w for s in _ENDS.split(text.lower()) if (w := _WORD.findall(s))]


def terms(words: list[str]) -> list[str]:
    """What may name an area: the whole sentence first, then pairs of words and words."""
    return ["^" + " ".join(words), *map(" ".join, zip(words, words[1:], strict=False)), *words]


def _split(spoken: str) -> list[list[str]]:
    return [s.split(" ") for s in spoken.split("\n")] if spoken else []


def lower_bound(k: Column, n: Column) -> Column:
    """Of a share of k in n."""
    p, zz = k / n, Z * Z
    return (p + zz / (2 * n) - Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


@F.pandas_udf(StringType())
def _spoken(texts: pd.Series) -> pd.Series:
    """A line a sentence, words parted by blanks: texts are taken apart once."""
    return pd.Series(["\n".join(map(" ".join, sentences(t))) if t else "" for t in texts], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def _terms_of(spoken: pd.Series) -> pd.Series:
    return pd.Series([list(dict.fromkeys(x for s in _split(t) for x in terms(s))) for t in spoken], dtype=object)


_spoken, _terms_of = _spoken.asNondeterministic(), _terms_of.asNondeterministic()  # so that no filter repeats them


def labelled(labels: DataFrame, areas: list[str], most: int = MAX_LABELLED) -> DataFrame:
    """doc_id and mask: a bit for each area of a labelled document, 0 for `none`. At most about `most` documents."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isin([*areas, "none"]))
    bit = F.lit(0)
    for i, a in enumerate(areas):
        bit = F.when(F.col("subject") == a, 1 << i).otherwise(bit)
    of = known.groupBy("doc_id").agg(F.bit_or(bit).alias("mask"))
    count = of.count()
    if count > most:
        of = of.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / count))
    return of


def _by_area(n_areas: int, mask: Column, weight: Column) -> list[Column]:
    return [F.sum(F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, weight).otherwise(0)).alias(f"k{i}") for i in range(n_areas)]


def _chosen(tallies: DataFrame, n_areas: int, least: int, share: float, most: int) -> dict[str, tuple[int, float]]:
    """term -> number of its area (-1: of none) and the bound of its share; tallies: term, mask, n. At most `most` terms."""
    by_term = tallies.groupBy("term").agg(F.sum("n").alias("n"), *_by_area(n_areas, F.col("mask"), F.col("n"))).where(F.col("n") >= least)
    counts = [F.col(f"k{i}") for i in range(n_areas)]
    best = by_term.select("term", "n", F.greatest(*counts, F.lit(0)).alias("k"), F.array(*counts).alias("_k"))
    best = best.withColumn("share", F.when(F.col("k") >= least, lower_bound(F.col("k"), F.col("n"))).otherwise(0.0))
    named = F.col("share") > share
    formula = F.col("term").startswith("^") & (F.col("n") >= MIN_FORMULA)
    rows = best.where(named | formula).select("term", "n", F.when(named, F.array_position("_k", F.col("k")) - 1).otherwise(-1).cast("int").alias("area"), "share")
    return {r.term: (r.area, r.share) for r in rows.orderBy(F.desc("n"), "term").limit(most).collect()}


def first_lexicon(sample: DataFrame, about: Sequence[str | None]) -> dict[str, tuple[int, float]]:
    """From a labelled sample (spoken, mask) and what each area is said to be about, which counts as one more document."""
    spark = sample.sparkSession
    told = [("\n".join(map(" ".join, sentences(t))), 1 << i) for i, t in enumerate(about) if t]
    rows = sample.select("spoken", "mask").unionByName(spark.createDataFrame(told, "spoken string, mask int"))
    held = rows.select("mask", F.explode(_terms_of("spoken")).alias("term"))
    return _chosen(held.groupBy("term", "mask").agg(F.count(F.lit(1)).alias("n")), len(about), SEED_DOCUMENTS, SEED_SHARE, MAX_TERMS)


class Judge:
    """Gives sentences to areas."""

    def __init__(self, lexicon: dict[str, tuple[int, float]], n_areas: int):
        self.n, self.whole, self.words, self.pairs = n_areas, {}, {}, {}
        for term, hit in lexicon.items():
            if term[0] == "^":
                self.whole[term[1:]] = hit[0]
            elif " " in term:
                a, b = term.split(" ")
                self.pairs.setdefault(a, {})[b] = hit
            else:
                self.words[term] = hit

    def area(self, sentence: str) -> int:
        if (whole := self.whole.get(sentence)) is not None:
            return whole
        best, surest, word, pair, open_ = -1, 0.0, self.words.get, self.pairs.get, None
        for w in sentence.split(" "):
            if open_ and (hit := open_.get(w)) and hit[1] > surest:
                best, surest = hit
            if (hit := word(w)) and hit[1] > surest:
                best, surest = hit
            open_ = pair(w)
        return best

    def counts(self, spoken: str) -> list[int]:
        """Sentences of each area."""
        out = [0] * self.n
        for sentence in spoken.split("\n") if spoken else ():
            if (area := self.area(sentence)) >= 0:
                out[area] += 1
        return out


def grown_lexicon(spoken: DataFrame, taught: DataFrame, seeds: dict[str, tuple[int, float]], n_areas: int) -> dict[str, tuple[int, float]]:
    """The lexicon from all documents that are labelled or that the seeds give an area to; each task adds up first."""
    shipped = spoken.sparkSession.sparkContext.broadcast(seeds)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge, held, size = Judge(shipped.value, n_areas), {}, 0

        def out() -> pd.DataFrame:
            rows = [(t, m, n) for m, counts in held.items() for t, n in counts.items()]
            return pd.DataFrame(rows, columns=["term", "mask", "n"])

        for batch in batches:
            for text, mask in zip(batch["spoken"], batch["mask"].tolist(), strict=True):
                if mask < 0:
                    mask = sum(1 << i for i, n in enumerate(judge.counts(text)) if n >= SENTENCES)
                    if not mask:
                        continue
                counts = held.setdefault(mask, Counter())
                size -= len(counts)
                counts.update({x for s in _split(text) for x in terms(s)})
                size += len(counts)
                if size > _KEPT_TERMS:
                    yield out()
                    held, size = {}, 0
        yield out()

    rows = spoken.join(F.broadcast(taught), "doc_id", "left")  # at most MAX_LABELLED rows
    rows = rows.select("spoken", F.coalesce("mask", F.lit(-1)).alias("mask"))
    return _chosen(rows.mapInPandas(tally, "term string, mask int, n long"), n_areas, MIN_DOCUMENTS, MIN_SHARE, MAX_TERMS)


def counted(spoken: DataFrame, lexicon: dict[str, tuple[int, float]], n_areas: int) -> DataFrame:
    """doc_id, section, source, address and counts, an array of sentences by area; a row a doc_id.

    Of other columns that differ between rows of a doc_id the smallest value counts."""
    shipped = spoken.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf(ArrayType(IntegerType()))
    def count(texts: pd.Series) -> pd.Series:
        judge = Judge(shipped.value, n_areas)
        return pd.Series([judge.counts(t) for t in texts], dtype=object)

    rows = spoken.withColumn("counts", count.asNondeterministic()("spoken"))
    sums = [F.sum(F.col("counts")[i]).cast("int").alias(f"c{i}") for i in range(n_areas)]
    merged = rows.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("section", "source", "address")], *sums)
    return merged.select("doc_id", "section", "source", "address", F.array(*[F.col(f"c{i}") for i in range(n_areas)]).alias("counts"))


def _about(n_areas: int) -> list[Column]:
    return [(F.col("counts")[i] >= SENTENCES).cast("int") for i in range(n_areas)]


def profile(counts: DataFrame, column: str, n_areas: int) -> DataFrame:
    """column and an array with a vote for each area: 2 (documents of this value are about it more often than others, by what
    the lexicon says of all of them), 0 (less often) or 1. Documents without any area by the lexicon don't count: how many
    these are tells of the lexicon, which may know one language less than another, not of areas."""
    counts = counts.where(F.exists("counts", lambda c: c >= SENTENCES))
    sums = [F.sum(a).alias(f"k{i}") for i, a in enumerate(_about(n_areas))]
    total = counts.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    base = [((total[f"k{i}"] or 0) + 0.5) / ((total.n or 0) + 1) for i in range(n_areas)]
    by = counts.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"), *sums)
    n = F.col("n")
    votes = [
        F.when(lower_bound(F.col(f"k{i}"), n) > 1.2 * b, 2).when(1 - lower_bound(n - F.col(f"k{i}"), n) < b / 1.2, 0).otherwise(1)
        for i, b in enumerate(base)
    ]
    return by.select(column, F.array(*votes).alias(f"{column}_votes"))


def at_address(counts: DataFrame, n_areas: int) -> DataFrame:
    """address, how many documents are there, and how many of them the lexicon gives to each area; where there are several."""
    by = counts.where("address is not null").groupBy("address").agg(F.count(F.lit(1)).alias("_there"), *[F.sum(a).alias(f"k{i}") for i, a in enumerate(_about(n_areas))])
    return by.where("_there > 1").select("address", "_there", F.array(*[F.col(f"k{i}") for i in range(n_areas)]).alias("_given"))


def vote_patterns(counts: DataFrame, n_areas: int) -> DataFrame:
    """doc_id and patterns: an array with the four votes on each area as one number."""
    rows = counts.join(profile(counts, "section", n_areas), "section", "left").join(profile(counts, "source", n_areas), "source", "left")
    rows = rows.join(at_address(counts, n_areas), "address", "left")

    def number(i: int) -> Column:
        lexicon = F.least(F.col("counts")[i], F.lit(_BINS[0] - 1))
        others, said = F.col("_there") - 1, F.col("_given")[i] - _about(n_areas)[i]
        address = F.when(F.col("_there").isNull(), 1).when(2 * said >= others, 2).otherwise(0)
        section, source = (F.coalesce(F.col(f"{c}_votes")[i], F.lit(1)) for c in ("section", "source"))
        return ((lexicon * _BINS[1] + address) * _BINS[2] + section) * _BINS[3] + source

    return rows.select("doc_id", F.array(*[number(i) for i in range(n_areas)]).alias("patterns"))


def posteriors(free: dict[int, int], yes: dict[int, int], no: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Of each pattern the probability that the document is about the area.

    free, yes, no: how many documents and areas have the pattern, unlabelled and by label. The votes of a function given
    the truth are one distribution each, learned with the share of true pairs. What the votes mean on the labelled pairs
    is where learning begins; then labelled pairs count with their labels, as LABEL_WEIGHT of all pairs if they are fewer, so
    that the classes stay what the labels mean however few they are."""
    patterns = np.array(sorted({*free, *yes, *no}), np.int64)
    if not len(patterns) or not sum(yes.values()):
        return {}
    votes = np.stack(np.unravel_index(patterns, _VOTES), 1)
    count = np.array([free.get(int(p), 0) for p in patterns], float)
    known = np.array([[no.get(int(p), 0), yes.get(int(p), 0)] for p in patterns], float)

    def belief_of(weight: np.ndarray) -> np.ndarray:
        logit = np.full(len(patterns), np.log(weight[:, 1].sum() + 1) - np.log(weight[:, 0].sum() + 1))
        for j, bins in enumerate(_VOTES):
            table = np.full((2, bins), 0.5)
            for y in (0, 1):
                np.add.at(table[y], votes[:, j], weight[:, y])
            says = np.arange(bins) != _SILENT[j]
            table[:, says] /= table[:, says].sum(1)[:, None]
            logit += np.where(says, np.log(table[1]) - np.log(table[0]), 0.0)[votes[:, j]]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    belief = belief_of(known)
    known *= max(1.0, LABEL_WEIGHT * count.sum() / known.sum())
    for _ in range(rounds):
        new = belief_of(known + count[:, None] * np.stack([1 - belief, belief], 1))
        settled = np.abs(new - belief).max() < 1e-6
        belief = new
        if settled:
            break
    return {int(p): float(b) for p, b in zip(patterns, belief, strict=True)}


def subject_posteriors(documents: DataFrame, labels: DataFrame, areas: list[str], about: Sequence[str | None] | None = None,
                       address: Sequence[str] = ("sitting_id", "speech_no"), max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, subject, posterior of each document and area with a posterior over 0.01. about: what each area is about."""
    spark, n = documents.sparkSession, len(areas)
    places = [F.col(c).cast("string") for c in address if c in documents.columns]
    place = F.concat_ws("\x1f", *places) if len(places) == len(address) else F.lit(None).cast("string")
    for c in places:
        place = F.when(c.isNotNull(), place)
    spoken = documents.where("doc_id is not null").select("doc_id", F.col("agenda_item").alias("section"), "source", place.alias("address"), _spoken(F.coalesce("text", F.lit(""))).alias("spoken"))
    spoken = materialise(spoken, "spoken")
    known = materialise(labelled(labels, areas, max_labelled), "labels")
    in_lexicon = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) > 0
    taught = known.where(in_lexicon)
    seeds = first_lexicon(spoken.join(F.broadcast(taught), "doc_id"), about or [None] * n)  # at most MAX_LABELLED rows
    lexicon = grown_lexicon(spoken, taught, seeds, n)
    patterns = materialise(vote_patterns(materialise(counted(spoken, lexicon, n), "counts"), n), "votes")
    anchors = F.broadcast(known.where(~in_lexicon))
    pairs = patterns.join(anchors, "doc_id", "left").select("mask", F.posexplode("patterns").alias("area", "pattern"))
    truth = F.when(F.col("mask").isNotNull(), F.getbit("mask", F.col("area")) == 1)
    seen = pairs.groupBy("pattern", truth.alias("known")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 x the product of _BINS rows
    by = {k: {r.pattern: r.n for r in seen if r.known is k} for k in (None, True, False)}
    table = {p: b for p, b in posteriors(by[None], by[True], by[False]).items() if b > 0.01}
    if not table:
        return spark.createDataFrame([], documents.select("doc_id").schema).withColumns({"subject": F.lit(""), "posterior": F.lit(0.0)})
    chance = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    judged = F.transform("patterns", lambda p, i: F.struct(F.element_at(F.array(*[F.lit(a) for a in areas]), i + 1).alias("subject"), F.try_element_at(chance, p).alias("posterior")))
    return patterns.select("doc_id", F.inline(F.filter(judged, lambda x: x["posterior"].isNotNull())))


def assigned(documents: DataFrame, labels: DataFrame, areas: list[str], about: Sequence[str | None] | None = None, **options) -> DataFrame:
    """doc_id and subject of each area that a document is about."""
    return subject_posteriors(documents, labels, areas, about, **options).where("posterior >= 0.5").select("doc_id", "subject")


def composition(subjects: DataFrame, documents: DataFrame, areas: DataFrame) -> DataFrame:
    """Of each area how many documents are about it, and their share of all documents."""
    total = documents.agg(F.countDistinct("doc_id").alias("_total"))
    found = areas.select("subject").join(subjects.groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents")), "subject", "left")
    n = F.coalesce("n_documents", F.lit(0).cast("long"))
    return found.join(F.broadcast(total)).select("subject", n.alias("n_documents"), F.coalesce(F.try_divide(n, F.col("_total")), F.lit(0.0)).alias("share"))
