import random

from conftest import rows
from waymark.operators.snapshots import snapshot_changes

DELIVERIES = "delivery_id long, sitemap_id long, snap_no int, received_at int, declared_rows long, loc string"
RECORDS = "delivery_id long, loc string, lastmod int, priority float, changefreq string, sitemap_id string, snap_no string"


def brute(deliveries, records):
    held = {}
    for d, loc, mod, pri, *_ in records:
        if loc is not None and d is not None:
            held.setdefault(d, {}).setdefault(loc, set()).add((mod, pri))
    snaps = {}
    for d, s, n, at, declared, _ in deliveries:
        if None not in (d, s, n) and declared == len(held.get(d, {})):
            snaps.setdefault(s, {}).setdefault(n, []).append((at is not None, at or 0, d))
    out = []
    for s, by in snaps.items():
        order = [(n, held.get(max(ds)[2], {})) for n, ds in sorted(by.items())]
        for (_, a), (n, b) in zip(order, order[1:]):
            out += [(s, n, k, "added") for k in b.keys() - a.keys()] + [(s, n, k, "removed") for k in a.keys() - b.keys()]
            out += [(s, n, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]]
    return sorted(out, key=repr)


def test_random_against_brute_force(spark):
    draw = random.Random(4)
    for _ in range(3):
        deliveries, records = [], []
        for d in range(60):
            n = draw.choice([0, 1, 5, 8])
            mine = [(d, draw.choice("abcdefgh"), draw.choice([None, 1, 2]), draw.choice([None, 0.0, 0.5]), "x", None, "y") for _ in range(n)]
            records += mine + mine[:2]
            distinct = len({r[1] for r in mine})
            deliveries.append((d, draw.choice([1, 2, 3, None]), draw.choice([1, 2, 3, 5, None]), draw.choice([None, 1, 2, 3]), draw.choice([distinct, distinct, distinct, 3, None]), "z"))
        records += [(None, "a", 1, 0.5, None, None, None), (3, None, 1, 0.5, None, None, None), (999, "a", 1, 0.5, None, None, None)]
        got = rows(snapshot_changes(spark.createDataFrame(deliveries, DELIVERIES), spark.createDataFrame(records, RECORDS)))
        assert got == brute(deliveries, records)


def test_empty_snapshot_and_empty_tables(spark):
    deliveries = [(1, 7, 1, 1, 1, None), (2, 7, 2, 1, 0, None)]
    got = rows(snapshot_changes(spark.createDataFrame(deliveries, DELIVERIES), spark.createDataFrame([(1, "a", None, None, None, None, None)], RECORDS)))
    assert got == [(7, 2, "a", "removed")]
    assert rows(snapshot_changes(spark.createDataFrame([], DELIVERIES), spark.createDataFrame([], RECORDS))) == []


def test_a_delivery_that_contradicts_itself(spark):
    deliveries = [(1, 7, 1, 1, 2, None), (2, 7, 2, 1, 2, None), (3, 7, 3, 1, 2, None)]
    records = [(d, k, m, p, None, None, None) for d, k, m, p in [(1, "a", 1, 0.5), (1, "a", 2, 0.1), (1, "b", 1, 0.0), (2, "a", 2, 0.1), (2, "a", 1, 0.5), (2, "b", 1, -0.0), (3, "a", 2, 0.5), (3, "b", 1, 0.0), (3, "b", 1, -0.0)]]
    got = rows(snapshot_changes(spark.createDataFrame(deliveries, DELIVERIES), spark.createDataFrame(records, RECORDS)))
    assert got == [(7, 3, "a", "changed")]


def test_many_deliveries_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("waymark.operators.snapshots.MAX_BROADCAST", 1)
    deliveries = [(1, 7, 1, 1, 1, None), (2, 7, 2, 1, 1, None)]
    got = snapshot_changes(spark.createDataFrame(deliveries, DELIVERIES), spark.createDataFrame([(1, "a", 1, None, None, None, None), (2, "b", 1, None, None, None, None)], RECORDS))
    assert rows(got) == [(7, 2, "a", "removed"), (7, 2, "b", "added")]


def test_the_records_travel_twice(spark):
    deliveries = spark.createDataFrame([(1, 7, 1, 1, 1, None)], DELIVERIES)
    plan = snapshot_changes(deliveries, spark.createDataFrame([], RECORDS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_key") and sum("Exchange hashpartitioning" in x and "_key" in x for x in plan.split("\n")) == 1
