"""Queries of the preparation operators over the project's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.incremental import Incremental
from waymark.operators.line_errors import failed_lines, loaded_lines
from waymark.operators.snapshots import snapshot_changes
from waymark.operators.timestamps import with_utc_micros
from waymark.storage import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "entry_listings").select(F.lit("entry").alias("record_kind"), F.col("entry_id").alias("record_id"), "host_id", "lastmod_text")
    indexes = table(spark, sf_dir, "index_listings").select(F.lit("index").alias("record_kind"), F.col("index_id").alias("record_id"), "host_id", "lastmod_text")
    hosts = table(spark, sf_dir, "hosts").select("host_id", "tz", "day_first")
    rows = entries.unionByName(indexes).where("lastmod_text is not null").join(hosts, "host_id", "left")
    return with_utc_micros(rows, "lastmod_text", "tz", "day_first").where("utc_us is not null").select("record_kind", "record_id", "utc_us")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "snapshot_deliveries"), table(spark, sf_dir, "entry_snapshots"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls over the feed: the runs of the first half of the time, then all. In the second, fingerprints tell what is new."""
    job = Incremental(spark, scratch_path(spark, "runs"))
    feed, runs = table(spark, sf_dir, "entry_feed"), table(spark, sf_dir, "feed_runs")
    middle = runs.agg(F.percentile_approx("started_at", 0.5)).first()[0]
    job.process(feed, runs.where(F.col("started_at") <= F.lit(middle)))
    job.process(feed, runs)
    return job.cases().select("run_id", "row_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_lines(table(spark, sf_dir, "raw_lines")).select("line_id", "reason")


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_lines(table(spark, sf_dir, "raw_lines"), "entry")


def p5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_lines(table(spark, sf_dir, "raw_lines"), "rule")


def p5_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_lines(table(spark, sf_dir, "raw_lines"), "delay")


QUERIES = {q.__name__: q for q in (p1_found, p2_found, p4_found, p5_found, p5_entries, p5_rules, p5_delays)}

ORACLES = {
    "p2_found": """
WITH keyed AS (SELECT DISTINCT delivery_id, loc, lastmod, priority FROM entry_snapshots WHERE loc IS NOT NULL AND delivery_id IS NOT NULL),
held AS (SELECT delivery_id, count(DISTINCT loc) AS n FROM keyed GROUP BY ALL),
complete AS (SELECT d.* FROM snapshot_deliveries d LEFT JOIN held h ON h.delivery_id = d.delivery_id WHERE coalesce(h.n, 0) = d.declared_rows),
snap AS (SELECT * FROM complete QUALIFY row_number() OVER (PARTITION BY sitemap_id, snap_no ORDER BY received_at DESC, delivery_id DESC) = 1),
pairs AS (SELECT sitemap_id, snap_no, delivery_id, lag(delivery_id) OVER (PARTITION BY sitemap_id ORDER BY snap_no) AS before FROM snap),
later AS (SELECT p.sitemap_id, p.snap_no, k.loc, k.lastmod, k.priority FROM pairs p JOIN keyed k ON k.delivery_id = p.delivery_id WHERE p.before IS NOT NULL),
earlier AS (SELECT p.sitemap_id, p.snap_no, k.loc, k.lastmod, k.priority FROM pairs p JOIN keyed k ON k.delivery_id = p.before),
news AS (SELECT * FROM later EXCEPT ALL SELECT * FROM earlier), olds AS (SELECT * FROM earlier EXCEPT ALL SELECT * FROM later),
touched AS (SELECT sitemap_id, snap_no, loc FROM news UNION SELECT sitemap_id, snap_no, loc FROM olds),
l AS (SELECT DISTINCT sitemap_id, snap_no, loc, true AS there FROM later), e AS (SELECT DISTINCT sitemap_id, snap_no, loc, true AS there FROM earlier)
SELECT t.sitemap_id, t.snap_no, t.loc, CASE WHEN e.there IS NULL THEN 'added' WHEN l.there IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM touched t LEFT JOIN l USING (sitemap_id, snap_no, loc) LEFT JOIN e USING (sitemap_id, snap_no, loc)""",
    "p4_found": """
WITH good AS (SELECT run_id, started_at, lag(started_at) OVER (ORDER BY run_id) AS before FROM feed_runs WHERE status = 'succeeded'),
best AS (SELECT g.run_id, f.loc, f.lastmod, f.row_id FROM entry_feed f JOIN good g ON f.arrived_at <= g.started_at AND (g.before IS NULL OR f.arrived_at > g.before)
  WHERE f.loc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g.run_id, f.loc ORDER BY f.lastmod DESC NULLS LAST, f.row_id) = 1),
seen AS (SELECT *, max(lastmod) OVER w AS latest, count(*) OVER w AS n FROM best WINDOW w AS (PARTITION BY loc ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run_id, row_id FROM seen WHERE n = 0 OR (lastmod IS NOT NULL AND (latest IS NULL OR lastmod > latest))""",
}

# another way to the same instants: formats tried one after the other, and the SQL engine's own zones
ORACLES["p1_found"] = r"""
WITH texts AS (SELECT 'entry' AS record_kind, entry_id AS record_id, host_id, lastmod_text AS t FROM entry_listings UNION ALL SELECT 'index', index_id, host_id, lastmod_text FROM index_listings),
tidy AS (SELECT record_kind, record_id, tz, day_first, replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '−', '-') AS s FROM texts JOIN hosts USING (host_id) WHERE t IS NOT NULL),
named AS (SELECT *, regexp_extract(s, '\[([A-Za-z_/]+)\]$', 1) AS bracket, regexp_replace(s, '\[[A-Za-z_/]+\]$', '') AS s1 FROM tidy),
spoken AS (SELECT *, regexp_extract(s1, ' ([A-Za-z]+/[A-Za-z_/]+)$', 1) AS name, regexp_replace(s1, ' [A-Za-z]+/[A-Za-z_/]+$', '') AS s2 FROM named),
short AS (SELECT *, CASE WHEN regexp_matches(s2, '\d ?[zZ]$') THEN 'Z' ELSE regexp_extract(s2, '\d ([A-Z]{3,4})( \d{4})?$', 1) END AS abbr,
  regexp_replace(regexp_replace(s2, '(\d) ?[zZ]$', '\1'), '(\d) [A-Z]{3,4}( \d{4})?$', '\1\2') AS s3 FROM spoken),
offs AS (SELECT *, regexp_extract(s3, '(?::\d\d|T\d{6}|[.,]\d+) ?([+-]\d\d:?(\d\d)?)$', 1) AS o, regexp_replace(s3, '(:\d\d|T\d{6}|[.,]\d+) ?[+-]\d\d(:?\d\d)?$', '\1') AS s4 FROM short),
fine AS (SELECT *, regexp_extract(s4, ':\d\d[.,](\d+)$', 1) AS f, regexp_replace(regexp_replace(s4, '(:\d\d)[.,]\d+$', '\1'), '^(\d{4}-\d\d-\d\d)[Tt_]', '\1 ') AS c FROM offs),
read AS (SELECT *,
  coalesce(try_strptime(c, '%Y-%m-%d %H:%M:%S'), try_strptime(c, '%Y-%m-%d %H:%M'), CASE WHEN regexp_full_match(c, '\d{8}T\d{6}') THEN try_strptime(c, '%Y%m%dT%H%M%S') END,
    CASE WHEN regexp_full_match(c, '\d{14}') THEN try_strptime(c, '%Y%m%d%H%M%S') END, try_strptime(c, '%d-%b-%Y %H:%M:%S'), try_strptime(regexp_replace(c, ' +', ' ', 'g'), '%a %b %d %H:%M:%S %Y'),
    try_strptime(c, '%a, %d %b %Y %H:%M:%S'), try_strptime(c, '%d %b %Y %H:%M:%S'), CASE WHEN regexp_matches(c, '-\d\d \d\d:') AND regexp_matches(c, 'day,') THEN try_strptime(c, '%A, %d-%b-%y %H:%M:%S') END,
    CASE WHEN regexp_matches(c, '^\d\d\.') THEN try_strptime(c, '%d.%m.%Y %H:%M') END,
    CASE WHEN regexp_matches(c, '^\d\d/') THEN CASE WHEN day_first THEN coalesce(try_strptime(c, '%d/%m/%Y %H:%M'), try_strptime(upper(c), '%d/%m/%Y %I:%M %p')) ELSE coalesce(try_strptime(c, '%m/%d/%Y %H:%M'), try_strptime(upper(c), '%m/%d/%Y %I:%M %p')) END END) AS clock,
  coalesce(CASE WHEN regexp_full_match(s, '\d{4}-\d\d-\d\d') THEN try_strptime(s, '%Y-%m-%d') END, CASE WHEN regexp_full_match(s, '\d{4}-\d\d') THEN try_strptime(s || '-01', '%Y-%m-%d') END,
    CASE WHEN regexp_full_match(s, '\d{4}/\d\d/\d\d') THEN try_strptime(s, '%Y/%m/%d') END, try_strptime(s, '%B %d, %Y'), try_strptime(s, '%d %B %Y'),
    CASE WHEN regexp_full_match(s, '\d{4}-\d{3}') THEN try_strptime(s, '%Y-%j') END, CASE WHEN regexp_full_match(s, '\d{4}-W\d\d-\d') THEN try_strptime(s, '%G-W%V-%u') END) AS day FROM fine),
placed AS (SELECT *, coalesce(nullif(bracket, ''), nullif(name, ''), tz) AS zone,
  CASE WHEN o <> '' THEN (CASE WHEN o LIKE '-%' THEN -1 ELSE 1 END) * (substr(o, 2, 2)::INT * 60 + coalesce(nullif(substr(replace(o, ':', ''), 4, 2), '')::INT, 0))
    WHEN abbr <> '' THEN CASE abbr WHEN 'Z' THEN 0 WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'CET' THEN 60 WHEN 'CEST' THEN 120 WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240 WHEN 'CST' THEN -360 WHEN 'CDT' THEN -300
      WHEN 'MST' THEN -420 WHEN 'MDT' THEN -360 WHEN 'PST' THEN -480 WHEN 'PDT' THEN -420 END END AS minutes FROM read),
seen AS (SELECT *, list_min(list_filter(list_transform([-60, -30, 0, 30, 60], lambda m: timezone(zone, clock) + to_minutes(m::BIGINT)), lambda u: timezone(zone, u) = clock)) AS instant FROM placed),
result AS (SELECT record_kind, record_id, CASE WHEN regexp_full_match(s, '\d{10}(\.\d+)?') THEN substr(s, 1, 10)::BIGINT * 1000000 + rpad(substr(s, 12, 6), 6, '0')::BIGINT
  WHEN regexp_full_match(s, '\d{13}') THEN s::BIGINT * 1000 WHEN regexp_full_match(s, '\d{16}') THEN s::BIGINT
  WHEN day IS NOT NULL THEN epoch_us(day) WHEN minutes IS NOT NULL THEN epoch_us(clock) - minutes::BIGINT * 60000000 + rpad(left(f, 6), 6, '0')::BIGINT
  WHEN o = '' AND abbr = '' THEN epoch_us(instant) + rpad(left(f, 6), 6, '0')::BIGINT END AS utc_us FROM seen)
SELECT record_kind, record_id, utc_us FROM result WHERE utc_us IS NOT NULL"""

_CELL = r"""(?:"(?:[^"]|"")*"|[^",]*)"""
_STRICT = f"{_CELL}(?:,{_CELL})*"
_LINES = rf"""
WITH cut AS (SELECT line_id, feed, regexp_replace(line, '[\r\n]+$', '') AS line FROM raw_lines),
split AS (SELECT *, CASE WHEN regexp_full_match(line, '(?s){_STRICT}') THEN
    list_transform(regexp_extract_all(',' || line, '(?s),({_CELL})', 1), lambda c: CASE WHEN c LIKE '"%' THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END) END AS f FROM cut),
judged AS (SELECT *, CASE WHEN line IS NULL THEN 'column_count' WHEN f IS NULL THEN 'quoting'
  WHEN len(f) <> (CASE feed WHEN 'entry' THEN 4 WHEN 'rule' THEN 4 WHEN 'delay' THEN 3 ELSE 0 END) THEN 'column_count'
  WHEN feed = 'entry' AND NOT (regexp_full_match(f[1], '(?is)https?://[a-z0-9.-]+(:0*([0-9]{{1,4}}|[1-5][0-9]{{4}}|6[0-4][0-9]{{3}}|65[0-4][0-9]{{2}}|655[0-2][0-9]|6553[0-5]))?([/?#][^\s\p{{Z}}\x0b\x1c-\x1f\x85]*)?')) THEN 'invalid_value'
  WHEN feed = 'rule' AND strpos(f[3], '$') NOT IN (0, length(f[3])) THEN 'invalid_value'
  WHEN feed = 'delay' AND f[3] <> '' AND NOT (regexp_full_match(f[3], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
    AND coalesce(try_cast(f[3] AS double) >= 0 AND isfinite(try_cast(f[3] AS double)), false)) THEN 'invalid_value' END AS reason FROM split)
"""
ORACLES["p5_found"] = _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL"
ORACLES["p5_entries"] = _LINES + "SELECT line_id, f[1] AS loc, f[2] AS lastmod, f[3] AS priority, f[4] AS changefreq FROM judged WHERE reason IS NULL AND feed = 'entry'"
ORACLES["p5_rules"] = _LINES + "SELECT line_id, f[1] AS robots_id, f[2] AS agent, f[3] AS pattern, f[4] AS allow FROM judged WHERE reason IS NULL AND feed = 'rule'"
ORACLES["p5_delays"] = _LINES + "SELECT line_id, f[1] AS robots_id, f[2] AS agent, f[3] AS crawl_delay FROM judged WHERE reason IS NULL AND feed = 'delay'"
