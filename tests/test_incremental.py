import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from waymark.operators.incremental import Incremental
from waymark.storage import scratch_path

T0 = datetime(2025, 3, 1)
FEED = "row_id long, loc string, lastmod timestamp, arrived_at timestamp, run_id string, rows int"
RUNS = "run_id int, started_at timestamp, status string"


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def brute(feed, runs):
    latest, seen_to, out = {}, None, []
    for run, start, status in sorted(runs, key=lambda r: r[0]):
        if status != "succeeded" or start is None:
            continue
        best = {}
        for row, loc, mod, arrived, *_ in feed:
            if loc is not None and arrived is not None and arrived <= start and (seen_to is None or arrived > seen_to):
                key = (mod is not None, mod or T0, -row)
                if loc not in best or key > best[loc]:
                    best[loc] = key
        for loc, key in best.items():
            if loc not in latest or (key[0] and (not latest[loc][0] or key[1] > latest[loc][1])):
                latest[loc] = key
                out.append((run, -key[2]))
        seen_to = start
    return sorted(out, key=repr)


def make(seed, n=400):
    draw = random.Random(seed)
    feed = [(i, draw.choice(["a", "b", "c", "d", None]) or None, at(draw.choice([None, *range(40)])), at(draw.choice([None, *range(100)])), "x", 1) for i in range(n)]
    feed += [(r[0], r[1], r[2], at(draw.randrange(100)), "x", 1) for r in feed[:60]]
    runs = [(i, at(10 * i + draw.randrange(5)), draw.choice(["succeeded", "succeeded", "failed", None])) for i in range(1, 10)]
    return feed, runs


def job(spark):
    return Incremental(spark, scratch_path(spark, "test"))


def found(j):
    return rows(j.cases().select("run_id", "row_id"))


@pytest.mark.parametrize("seed", [1, 2])
def test_one_call_and_a_call_a_run_agree(spark, seed):
    feed, runs = make(seed)
    whole, stepwise = job(spark), job(spark)
    whole.process(spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS))
    assert found(whole) == brute(feed, runs)
    for k in (3, 6, len(runs)):
        arrived = [f for f in feed if f[3] is None or f[3] <= (runs[k - 1][1] + timedelta(hours=1))]
        computed = stepwise.process(spark.createDataFrame(arrived, FEED), spark.createDataFrame(runs[:k], RUNS))
        assert found(stepwise) == brute(arrived, runs[:k])
        assert all(i > 3 for i in computed) or k == 3
    assert stepwise.process(spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS)) == []


def test_only_a_changed_partition_is_computed(spark):
    feed, runs = make(3)
    runs = [(i, s, "succeeded") for i, s, _ in runs]
    j = job(spark)
    j.process(spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS))
    late = [*feed, (9999, "new", at(1), at(35), "x", 1)]
    assert j.process(spark.createDataFrame(late, FEED), spark.createDataFrame(runs, RUNS)) == [4 - (runs[2][1] >= at(35))]
    assert found(j) == brute(late, runs)
    fewer = [f for f in late if f[3] is None or not at(50) < f[3] <= at(75)]
    j.process(spark.createDataFrame(fewer, FEED), spark.createDataFrame(runs, RUNS))
    assert found(j) == brute(fewer, runs)


@pytest.mark.parametrize("last", ["sums", "best", "cases", "prints"])
def test_a_call_that_dies_before_a_write_leaves_nothing_that_counts(spark, monkeypatch, last):
    feed, runs = make(5)
    feeds = [spark.createDataFrame(f, FEED) for f in (feed, [*feed, (9999, "a", at(99), at(15), "x", 1)])]
    before = spark.createDataFrame(runs[:6], RUNS)
    j = job(spark)
    j.process(feeds[0], before)
    held = found(j)
    write = Incremental._write

    def dies(self, df, name, by):
        assert found(self) == held  # a reader in between
        if name == last:
            raise RuntimeError("lost")
        write(self, df, name, by)

    monkeypatch.setattr(Incremental, "_write", dies)
    if last != "sums":  # which a feed without files doesn't write
        with pytest.raises(RuntimeError):
            j.process(feeds[1], spark.createDataFrame(runs, RUNS))
    assert found(j) == held
    monkeypatch.setattr(Incremental, "_write", write)
    assert j.process(feeds[0], before) == [] and found(j) == held
    j.process(feeds[1], spark.createDataFrame(runs, RUNS))
    assert found(j) == brute([*feed, (9999, "a", at(99), at(15), "x", 1)], runs)


def test_only_new_files_and_cut_stretches_are_read(spark, tmp_path):
    draw = random.Random(8)
    feed = [(i, draw.choice("abcdefgh"), at(draw.choice([None, *range(60)])), at(i / 10 + 0.05), "x", 1) for i in range(900)]
    folder, runs = str(tmp_path / "feed"), [(i, at(10 * i), "succeeded") for i in range(1, 9)]
    put = lambda part: spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(folder)
    for k in range(4):
        put(feed[100 * k : 100 * k + 100])  # a file for ten hours
    read, table = (lambda: spark.read.parquet(folder)), (lambda n: spark.createDataFrame(runs[:n], RUNS))
    j = job(spark)
    assert j.process(read(), table(3)) == [1, 2, 3] and j.report["files_summed"] == 4
    assert j.process(read(), table(3)) == [] and j.report["files_summed"] == 0 and j.report["files"] == 4
    put(feed[400:500])
    assert j.process(read(), table(5)) == [4, 5] and j.report["files_read"] == 2
    assert j.report["files_summed"] == 2  # the new one, and the one in the open stretch that run 4 ends
    assert found(j) == brute(feed[:500], runs[:5])
    put(feed[500:])
    assert j.process(read(), table(8)) == [6, 7, 8] and j.report["files_summed"] == 1 and found(j) == brute(feed, runs)
    assert set(j.report["replaced"]) <= {6, 7, 8}
    put([(5000, "a", at(999), at(35), "x", 1)])  # late: into an old partition
    assert j.process(read(), table(8)) == [4] and j.report["files_summed"] == 1 and j.report["files_read"] <= 3
    assert found(j) == brute([*feed, (5000, "a", at(999), at(35), "x", 1)], runs)
    gone = [(i, s, "failed" if i == 5 else t) for i, s, t in runs]
    assert j.process(read(), spark.createDataFrame(gone, RUNS)) == [6] and j.report["files_summed"] == 0
    assert found(j) == brute([*feed, (5000, "a", at(999), at(35), "x", 1)], gone)


def test_empty_tables(spark):
    j = job(spark)
    empty = spark.createDataFrame([], FEED)
    assert j.process(empty, spark.createDataFrame([], RUNS)) == [] and found(j) == []
    j.process(empty, spark.createDataFrame([(1, at(1), "succeeded"), (2, at(1), "succeeded")], RUNS))
    assert found(j) == []


def test_runs_that_are_no_longer_successful_leave_nothing(spark):
    feed, runs = make(7)
    runs = [(i, s, "succeeded") for i, s, _ in runs]
    j = job(spark)
    rows_of = spark.createDataFrame(feed, FEED)
    j.process(rows_of, spark.createDataFrame(runs, RUNS))
    for failed in ({4}, {1, 4, 9}, {1}, set(range(1, 10)), {2}, set()):
        now = [(i, s, "failed" if i in failed else t) for i, s, t in runs]
        j.process(rows_of, spark.createDataFrame(now, RUNS))
        assert found(j) == brute(feed, now)
