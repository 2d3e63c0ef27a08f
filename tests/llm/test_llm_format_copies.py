import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import rows

fc = pytest.importorskip("waymark.llm.format_copies")


def canon(text):
    words = lambda s: tuple(re.findall(r"[^\W_]+", s.lower()))
    path, _, query = text.partition("?")
    return words(path), frozenset(Counter(w for f in re.split("[&;]", query) if (w := words(f))).items())


def texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(["a", "B", "b", "é", "É", "1", " ", "-", "/", "?", "&", ";", "=", "　", "ab"]) for _ in range(draw.randint(0, 9))) for _ in range(n)]


def test_hashes_and_comparison_follow_the_definition():
    sample = texts(3000, 1) + ["", "?", "x?b=1&a=2", "X ?a=2;b=1&&", "x?a=2&a=2&b=1", "x?ab=1", "x?a b=1"]
    h1, h2 = fc.hash_texts(sample)
    by_hash, by_key = {}, {}
    for i, t in enumerate(sample):
        by_hash.setdefault((h1[i], h2[i]), set()).add(i)
        by_key.setdefault(canon(t), set()).add(i)
    assert sorted(map(sorted, by_hash.values())) == sorted(map(sorted, by_key.values()))
    left, right = sample[:-1], sample[1:]
    assert fc.same_texts(left, right).tolist() == [canon(a) == canon(b) for a, b in zip(left, right)]
    assert all((fc.exact_key(a) == fc.exact_key(b)) == (canon(a) == canon(b)) for a, b in zip(left, right))


def test_long_texts_go_in_chunks(monkeypatch):
    monkeypatch.setattr(fc, "_CHUNK", 50)
    sample = texts(200, 2) + ["A " * 500, "a," * 500]
    h1, _ = fc.hash_texts(sample)
    assert h1[-1] == h1[-2] and fc.same_texts(sample, sample).all()


def test_groups_against_brute_force(spark):
    data = [(i, t) for i, t in enumerate(texts(800, 3))] + [(5000, None), (None, "a"), (3, texts(800, 3)[3])] + [(6000 + i, "Hot " + "-" * (i % 7)) for i in range(400)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "id long, loc string, h1 int, first_id string")
    first, want = {}, []
    for i, t in sorted((x for x in data if None not in x), key=lambda x: x[0]):
        k = first.setdefault(canon(t), i)
        if k != i:
            want.append((k, i))
    assert rows(fc.format_groups(df, "id", "loc")) == sorted(set(want), key=repr)
    counts = Counter({i: 1 for i in first.values()}) + Counter(k for k, _ in set(want))
    assert dict(rows(fc.collapse_formats(df, "id", "loc"))) == dict(counts)


def test_rows_that_only_share_hashes_are_grouped_by_their_words(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fc, "_hashes", lambda c: F.struct(F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2")))
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "A-B"), (4, "C!"), (5, "d"), (6, "c")], "id long, loc string")
    assert rows(fc.format_groups(df, "id", "loc")) == [(1, 3), (2, 4), (2, 6)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, loc string")
    assert rows(fc.format_groups(df, "id", "loc")) == [] and rows(fc.collapse_formats(df, "id", "loc")) == []
    assert len(fc.hash_texts([])[0]) == 0 and isinstance(fc.same_texts([], []), np.ndarray)


def test_fields_that_only_share_hashes_may_stand_in_another_order(monkeypatch):
    monkeypatch.setattr(fc.Symbols, "_hash", lambda self, base, at, first, spot: np.zeros(len(first), np.uint64))
    left = ["p?a=1&b=2", "p?a=1&b=2", "p?a=1", "p?a&a&b"]
    assert fc.same_texts(left, ["P?b=2;a=1", "p?a=1&b=3", "p a=1", "p?a&b&b"]).tolist() == [True, False, False, False]


def test_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "A"), (2, "A"), (2, "b"), (3, "B"), (1, "c")], "id long, loc string")
    assert rows(fc.format_groups(df, "id", "loc")) == [(1, 2), (2, 3)]


def test_every_text_is_hashed_once(spark):
    hashed = spark.createDataFrame([(1, "a")], "id long, loc string").select("id", fc._hashes("loc").alias("_h")).select("_h.h1").where("h1 > 0")
    assert hashed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
