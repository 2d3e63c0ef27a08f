import random

import numpy as np
import pytest

mixing = pytest.importorskip("waymark.llm.mixing")
pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, source string, text string, copies int, chance double"
TARGETS = "source string, target_share double, max_repeats int"


def test_expected_copies():
    got = mixing.expected_copies({"a": 100, "b": 50, "c": 10}, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 2), ("d", 0.0, 3), (None, 0.1, 1)])
    assert got["c"] == 2.0 and got["d"] == 0.0 and abs(got["a"] * 100 + got["b"] * 50 + 20 - 160) < 1e-9
    assert abs(got["a"] * 100 / (got["b"] * 50) - 5 / 3) < 1e-9
    assert mixing.expected_copies({}, [("a", 1.0, 1)]) == {"a": 0.0}
    assert mixing.expected_copies({"a": 5}, [("a", None, None)]) == {"a": 0.0}


def test_flight_keeps_totals_and_expectations():
    draw = random.Random(3)
    size = [float(int(draw.paretovariate(1.2) * 50)) for _ in range(2000)]
    chance = [0.37] * len(size)
    out = mixing.fly(np.array(chance), np.array(size), np.random.default_rng(1), True)
    assert set(out) == {0.0, 1.0}
    assert abs(sum(out) - 740) <= 2 and abs(sum(o * s for o, s in zip(out, size)) - 0.37 * sum(size)) < 0.005 * sum(size)
    flown = mixing.fly(np.array(chance), np.array(size), np.random.default_rng(2), False)
    assert abs(flown.sum() - 740) < 1e-6 and abs(flown @ np.array(size) - 0.37 * sum(size)) < 1e-4 and ((flown > 0) & (flown < 1)).sum() <= 2
    empty = np.zeros(0)
    assert len(mixing.fly(empty, empty, np.random.default_rng(1), True)) == 0
    assert sorted(mixing.fly(np.array([0.5, 0.5]), np.array([3.0, 3.0]), np.random.default_rng(1), False)) == [0.0, 1.0]


@pytest.mark.parametrize("size", [[1.0, 2.0, 3.0, 4.0, 50.0], [5.0] * 7, [300.0, 200.0] + [1.0 + k % 3 for k in range(40)]])
@pytest.mark.parametrize("giant", [mixing.GIANT, 2.0])
def test_both_kinds_of_move_keep_the_chances(monkeypatch, size, giant):
    monkeypatch.setattr(mixing, "GIANT", giant)  # 2.0: no document moves first
    size, n = np.array(size), 3000
    hits = sum(mixing.fly(np.full(len(size), 0.4), size, np.random.default_rng(seed), False) for seed in range(n))
    assert np.abs(hits / n - 0.4).max() < 0.045


def make(spark):
    draw = random.Random(5)
    data = [(i, draw.choice("aaaab"), "word " * draw.randint(0, 40), 7, 0.1) for i in range(3000)]
    data += [(5000 + i, s, t, 7, 0.1) for i, (s, t) in enumerate([("a", None), (None, "x"), ("other", "x"), ("c", "y " * 30), ("c", "y " * 30), ("a", "")])]
    return spark.createDataFrame(data, DOCS), spark.createDataFrame([("a", 0.5, 1), ("b", 0.44, 4), ("c", 0.06, 2), ("none", 0.0, 1)], TARGETS)


@pytest.mark.parametrize("block", [mixing.BLOCK, 300])
def test_shares(spark, block):
    documents, targets = make(spark)
    mix = mixing.mixed(documents, targets, block=block)
    assert mix.groupBy("doc_id").count().where("count > 1").count() == 0
    rows = {r.source: r for r in mixing.shares(mix, targets).collect()}
    assert rows["c"].most_copies == 2 and rows["a"].most_copies == 1 and rows["b"].most_copies <= 4 and rows["none"].n_documents == 0
    left = 1 - rows["c"].actual_share
    assert abs(rows["a"].actual_share - left * 0.5 / 0.94) < 0.01 and abs(sum(r.actual_share for r in rows.values()) - 1) < 1e-9
    again = mixing.mixed(documents, targets, block=block)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mix.collect()))


def test_empty(spark):
    documents, targets = make(spark)
    assert mixing.mixed(documents.where("false"), targets).count() == 0
    assert mixing.mixed(documents.limit(10), targets.where("false")).count() == 0


def test_the_landing_misses_by_least():
    size, chance = np.array([9000.0] + [10.0] * 50), np.full(51, 0.98)
    for seed in range(50):
        out = mixing.fly(chance, size, np.random.default_rng(seed), True)
        assert out[0] == 1.0 and abs(out @ size - chance @ size) < 200
