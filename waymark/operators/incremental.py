"""Runs that process only what is new or later than before, and that can be lost at any point.

The feed is cut into partitions by the successful run that sees a row first. Each partition has a fingerprint: its row
count and the sums of its row hashes, which don't depend on the rows' order. Being sums, they add up over the feed's files
and over stretches of time between two starts of runs, so a table of them by file and stretch is kept, and a call reads
only files that are new or changed, or whose stretches a new run cuts. A call of `process`

1. brings the table of sums up to date and adds them up to the fingerprints of the partitions,
2. compares these with the fingerprints that the last finished call left: only partitions that differ are computed,
   from the files that hold their rows; of each the best row of each loc is kept (`best`),
3. finds the locs whose best rows differ from before, and judges only these anew over all runs; partitions of `cases`
   whose rows change by that are replaced, the others stay,
4. leaves the new fingerprints behind, after everything else (`prints`).

Every partition is written through dynamic partition overwrite under the number of the call, and the fingerprints name the
number that holds for each. So a reader sees the last finished call, also while another one is at work, and a call that
dies leaves nothing that counts: the next one has the same number, finds the same partitions changed and writes them
again. What no call needs any more is removed at the end of the next. One call at a time may write.

A feed that isn't read from files (or more than MAX_LISTED files at once) is read whole in each call.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.storage import exists, materialise

MAX_LISTED = 10_000  # files that one scan is narrowed down to by name
_LANE = (1 << 21) - 1  # three lanes of 21 bits: their sums stay whole for 2^42 rows a partition


def row_fingerprint(columns: list[Column]) -> list[Column]:
    """Aggregates of a partition: its count and three additive hashes of its rows."""
    h = F.xxhash64(*columns)
    lanes = [F.sum(F.shiftrightunsigned(h, 21 * i).bitwiseAND(F.lit(_LANE))).alias(f"hash{i}") for i in range(3)]
    return [F.count(F.lit(1)).alias("rows"), *lanes]


def run_starts(runs: DataFrame) -> list[tuple[int, int]]:
    """run_id and start (microseconds) of the successful runs in order of time: a row a run of the job, not of the data.

    run_id rises with time. Of runs that start at the same instant the first sees all the rows."""
    rows = runs.where("status = 'succeeded' and run_id is not null and started_at is not null")
    found = sorted((r.run_id, r.us) for r in rows.select("run_id", F.unix_micros("started_at").alias("us")).collect())
    return [x for i, x in enumerate(found) if i == 0 or x[1] > found[i - 1][1]]


def _bucket(rows: DataFrame, arrived: str, bounds: list[int], name: str) -> DataFrame:
    """rows with `name`, how many bounds (microseconds) lie before the arrival: a binary search in the JVM."""
    if not bounds:
        return rows.withColumn(name, F.lit(0))
    placed = rows.withColumn("_at", (F.unix_micros(arrived) - 1).cast("double"))  # what arrives at a start is seen by it
    splits = [-math.inf, *[float(us) for us in bounds], math.inf]
    placed = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket").transform(placed)
    return placed.withColumn(name, F.col("_bucket").cast("int")).drop("_at", "_bucket")


def with_run(feed: DataFrame, starts: list[tuple[int, int]], arrived: str = "arrived_at") -> DataFrame:
    """feed with run_id, the first successful run that sees the row.

    Rows that no run has seen yet, and rows without an arrival time, are left out."""
    if not starts:
        return feed.withColumn("run_id", F.lit(None).cast("int")).where(F.lit(False))
    last = F.timestamp_micros(F.lit(starts[-1][1]))
    rows = _bucket(feed.where(F.col(arrived).isNotNull() & (F.col(arrived) <= last)), arrived, [us for _, us in starts], "_run")
    return rows.withColumn("run_id", F.element_at(F.array(*[F.lit(i) for i, _ in starts]), F.col("_run") + 1)).drop("_run")


def best_of_run(seen: DataFrame) -> DataFrame:
    """run_id, loc, lastmod, row_id: of each loc the row with the latest lastmod (null first), of equals the smallest row_id."""
    best = seen.where("loc is not null").groupBy("run_id", "loc").agg(F.max(F.struct("lastmod", (-F.col("row_id")).alias("row"))).alias("_best"))
    return best.select("run_id", "loc", F.col("_best.lastmod").alias("lastmod"), (-F.col("_best.row")).alias("row_id"))


def new_or_later(best: DataFrame) -> DataFrame:
    """The rows of best that are the first of their loc or later than all earlier ones.

    After best_of_run a loc has at most one row a run, so that no window partition outgrows the number of runs."""
    earlier = Window.partitionBy("loc").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = best.select("*", F.max("lastmod").over(earlier).alias("_latest"), F.count(F.lit(1)).over(earlier).alias("_n"))
    later = F.col("lastmod").isNotNull() & (F.col("_latest").isNull() | (F.col("lastmod") > F.col("_latest")))
    return rows.where((F.col("_n") == 0) | later).select("run_id", "loc", "lastmod", "row_id")


_ROWS = "run_id int, loc string, lastmod timestamp, row_id long"
_STORED = f"{_ROWS}, version long"
_PRINTS = "run_id int, us long, rows long, hash0 long, hash1 long, hash2 long, best long, cases long, call long"
_SUMS = "file string, size long, changed timestamp, since long, until long, rows long, hash0 long, hash1 long, hash2 long"
_LANES = ["rows", "hash0", "hash1", "hash2"]


def _changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that are in one of the two only."""
    columns = ["run_id", "loc", "lastmod", "row_id"]
    both = old.select(*columns, F.lit(-1).alias("_sign")).unionByName(new.select(*columns, F.lit(1).alias("_sign")))
    return both.groupBy(*columns).agg(F.sum("_sign").alias("_net")).where("_net <> 0").drop("_net")


class Incremental:
    """The state of one job in a folder. `report` tells of the last call: the runs it computed, the runs whose cases it
    replaced, and the files (with their bytes) that it read for fingerprints and for rows, of how many."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.report = spark, folder.rstrip("/"), {}

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _prints(self) -> tuple[int, dict[int, dict]]:
        """Number of the last finished call, and what it left for each run (a row a run)."""
        table = self._table("prints", _PRINTS)
        last = table.agg(F.max("call")).first()[0]
        if last is None:
            return 0, {}
        return last, {r.run_id: r.asDict() for r in table.where(F.col("call") == last).collect() if r.run_id is not None}

    def _stored(self, name: str, prints: dict[int, dict], runs=None) -> DataFrame:
        """run_id, loc, lastmod, row_id of the partitions that hold for these runs: other folders aren't read."""
        by: dict[int, list[int]] = {}
        for run, row in prints.items():
            if row[name] is not None and (runs is None or run in runs):
                by.setdefault(row[name], []).append(run)
        held = F.lit(False)
        for version, of in by.items():
            held = held | ((F.col("version") == version) & F.col("run_id").isin(of))
        return self._table(name, _STORED).where(held).drop("version")

    def cases(self) -> DataFrame:
        """run_id, row_id, loc, lastmod: what each run processed, as the last finished call left it."""
        return self._stored("cases", self._prints()[1]).select("run_id", "row_id", "loc", "lastmod")

    # ------------------------------------------------------------------------------------------ fingerprints

    def _files(self, feed: DataFrame) -> DataFrame | None:
        """file, size, changed of the files that a feed is read from; their contents aren't. None if it isn't read from files."""
        names = feed.inputFiles()
        try:
            feed.select("_metadata.file_path")
        except AnalysisException:
            return None
        if not names:
            return None
        listed = self.spark.read.format("binaryFile").load(sorted({n.rsplit("/", 1)[0] for n in names}))
        return listed.select(_name("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))

    @staticmethod
    def _only(feed: DataFrame, files: list[str] | None) -> DataFrame:
        """The rows of some files (None: of all): a predicate on file names, by which the scan leaves out the others."""
        if files is None or len(files) > MAX_LISTED:
            return feed
        return feed.where(_name("_metadata.file_path").isin(files))

    def _sums(self, feed: DataFrame, bounds: list[int], call: int) -> DataFrame:
        """Sums by file and stretch (since, until] of the whole feed; only files that need it are read."""
        columns = ["row_id", "loc", "lastmod", "arrived_at"]
        lows, highs = F.array(*[F.lit(b).cast("long") for b in [None, *bounds]]), F.array(*[F.lit(b).cast("long") for b in [*bounds, None]])
        listed = self._files(feed)

        def summed(rows: DataFrame, keys: list) -> DataFrame:
            placed = _bucket(rows.select(*columns, *keys).where("arrived_at is not null"), "arrived_at", bounds, "_slot")
            names = [k for k in placed.columns if k not in columns]
            out = placed.groupBy(*names).agg(*row_fingerprint([F.col(c) for c in columns]))
            return out.withColumns({"since": F.element_at(lows, F.col("_slot") + 1), "until": F.element_at(highs, F.col("_slot") + 1)}).drop("_slot")

        if listed is None:
            self.report |= {"files": 0, "files_summed": 0, "bytes_summed": 0}
            return summed(feed, [])
        old = self._table("sums", f"{_SUMS}, call long").where(F.col("call") == call - 1).drop("call")
        # stretches that a start, new since, cuts: a row a stretch
        cut = [(r.since, r.until) for r in old.where("rows > 0").select("since", "until").distinct().collect()
               if any((r.since is None or b > r.since) and (r.until is None or b < r.until) for b in bounds)]
        whole = F.lit(True)
        for since, until in cut:
            whole = whole & ~(F.col("since").eqNullSafe(F.lit(since)) & F.col("until").eqNullSafe(F.lit(until)) & (F.col("rows") > 0))
        good = old.groupBy("file", "size", "changed").agg(F.bool_and(whole).alias("_whole")).where("_whole")
        rest = listed.join(good, ["file", "size", "changed"], "left_anti").select("file", "size")
        names = {r.file: r["size"] for r in rest.limit(MAX_LISTED + 1).collect()}
        n = listed.count()
        narrow = list(names) if len(names) < min(n, MAX_LISTED + 1) else None
        kept = old.join(listed.join(good, ["file", "size", "changed"]).select("file"), "file", "left_semi")
        fresh = summed(self._only(feed, narrow), [_name("_metadata.file_path").alias("file")])
        if narrow is None and len(names) > MAX_LISTED:
            kept, again = kept.limit(0), listed
        else:
            again = rest.join(listed.select("file", "changed"), "file")
        fresh = again.join(fresh, "file", "left").na.fill(0, _LANES)
        order = [c.split()[0] for c in _SUMS.split(", ")]
        self._write(kept.select(order).unionByName(fresh.select(order)).withColumn("call", F.lit(call).cast("long")), "sums", ["call"])
        self.report |= {"files": n, "files_summed": len(names) if narrow is not None else n, "bytes_summed": sum(names.values())}
        return self._table("sums", f"{_SUMS}, call long").where(F.col("call") == call)

    # ------------------------------------------------------------------------------------------ a call

    def process(self, feed: DataFrame, runs: DataFrame) -> list[int]:
        """Bring `cases` up to date with the feed and the successful runs; the run_ids whose partitions were computed.

        Nothing is computed for partitions whose fingerprints are those of the last finished call."""
        last, old = self._prints()
        call, self.report = last + 1, {"runs": [], "replaced": [], "files": 0, "files_summed": 0, "bytes_summed": 0, "files_read": 0}
        starts = run_starts(runs)
        bounds = sorted({r.us for r in runs.where("started_at is not null").select(F.unix_micros("started_at").alias("us")).collect()})
        sums = self._sums(feed, bounds, call)
        # the stretches of each run: a row a stretch
        first = {b: next((i for i, us in starts if us >= b), None) for b in bounds}
        stretches = [(b, i) for b, i in first.items() if i is not None]
        placed = sums.join(F.broadcast(self.spark.createDataFrame(stretches, "until long, run_id int")), "until")
        found = {r.run_id: r for r in placed.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in _LANES]).collect()}
        new = {i: {"run_id": i, "us": us, **{c: found[i][c] if i in found else 0 for c in _LANES}} for i, us in starts}
        same = [i for i in new if i in old and all(old[i][c] == new[i][c] for c in ("us", *_LANES))]
        changed, gone = [i for i in new if i not in same], [i for i in old if i not in new]
        if not changed and not gone:
            return []
        self.report["runs"] = changed
        for i, row in new.items():
            row |= {"best": old[i]["best"] if i in same else call, "cases": old[i]["cases"] if i in old else None}
        if changed:
            self._write(self._best(feed, placed, starts, changed).withColumn("version", F.lit(call).cast("long")).hint("rebalance", "run_id"), "best", ["run_id", "version"])
        before = self._stored("best", old, {*changed, *gone})
        fresh = self._stored("best", new, set(changed))
        if not same and not old:
            cases, touched = new_or_later(fresh), changed
        else:
            locs = materialise(_changes(before, fresh).select("loc").distinct(), "locs")
            judged = materialise(new_or_later(self._stored("best", new).join(locs, "loc", "left_semi")), "judged")
            earlier = self._stored("cases", old)
            touched = [r.run_id for r in _changes(earlier.join(locs, "loc", "left_semi"), judged).select("run_id").distinct().collect() if r.run_id in new]
            stay = self._stored("cases", old, set(touched)).join(locs, "loc", "left_anti")
            cases = stay.unionByName(judged.where(F.col("run_id").isin(touched)))
        if touched:
            self._write(cases.withColumn("version", F.lit(call).cast("long")).hint("rebalance", "run_id"), "cases", ["run_id", "version"])
            for i in touched:
                new[i]["cases"] = call
        self.report["replaced"] = touched
        self._write_prints(call, new)
        self._sweep(call, old, new)
        return changed

    def _best(self, feed: DataFrame, placed: DataFrame, starts: list[tuple[int, int]], changed: list[int]) -> DataFrame:
        """The best rows of some runs, from the files and the time that hold their rows."""
        if "file" in placed.columns:
            names = [r.file for r in placed.where(F.col("run_id").isin(changed) & (F.col("rows") > 0)).select("file").distinct().limit(MAX_LISTED + 1).collect()]
            feed = self._only(feed, names)
            self.report["files_read"] = len(names)
        index = [i for i, _ in starts]
        low, high = min(map(index.index, changed)), max(map(index.index, changed))
        rows = feed.select("row_id", "loc", "lastmod", "arrived_at").where(F.col("arrived_at") <= F.timestamp_micros(F.lit(starts[high][1])))
        if low:
            rows = rows.where(F.col("arrived_at") > F.timestamp_micros(F.lit(starts[low - 1][1])))
        seen = with_run(rows, starts)
        return best_of_run(seen if len(changed) == high - low + 1 else seen.where(F.col("run_id").isin(changed)))

    def _write_prints(self, call: int, new: dict[int, dict]) -> None:
        """One file, written last. A call without runs leaves a row without run_id."""
        names = [c.split()[0] for c in _PRINTS.split(", ")]
        rows = [tuple((row | {"call": call})[c] for c in names) for row in new.values()] or [(*[None] * 8, call)]
        self._write(self.spark.createDataFrame(rows, _PRINTS).coalesce(1), "prints", ["call"])

    def _write(self, df: DataFrame, name: str, by: list[str]) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def _sweep(self, call: int, old: dict[int, dict], new: dict[int, dict]) -> None:
        """Remove what neither this call nor the one before it (somebody may be reading that) names."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        files = hadoop(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name, pattern in (("best", "run_id=*/version=*"), ("cases", "run_id=*/version=*"), ("sums", "call=*"), ("prints", "call=*")):
            needed = {f"run_id={i}/version={row[name]}" for rows in (old, new) for i, row in rows.items()} if "/" in pattern else {f"call={call}", f"call={call - 1}"}
            for status in files.globStatus(hadoop(f"{self.folder}/{name}/{pattern}")) or []:
                if "/".join(status.getPath().toString().split("/")[-1 - pattern.count("/") :]) not in needed:
                    files.delete(status.getPath(), True)


def _name(path: str) -> Column:
    """Names of files as written by either source: one slash behind the scheme."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")
