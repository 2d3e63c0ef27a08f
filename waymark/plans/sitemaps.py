"""Queries of the sitemap operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark import counting
from waymark.plans.policies import norm_sql, path_sql
from waymark.plans.preparation import _LINES, table
from waymark.operators.line_errors import loaded_lines
from waymark.robots import policy
from waymark.sitemap import build, parse, records
from waymark.storage import materialise

NOW = "2024-06-01 12:00:00"


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entry_snapshots").select("delivery_id", "loc", F.col("lastmod").cast("timestamp").alias("lastmod"), records.frequency(F.col("changefreq")).alias("changefreq"))


def freq_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(spark, sf_dir).select("delivery_id", "loc", "changefreq", F.unix_micros(records.next_date(F.col("changefreq"), F.col("lastmod"))).alias("next_us")).where("next_us is not null")


def freq_outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    outdated = records.is_outdated(F.col("changefreq"), F.col("lastmod"), F.lit(NOW).cast("timestamp"))
    return _stamped(spark, sf_dir).groupBy("delivery_id").agg(F.count_if(outdated).alias("n_outdated"), F.count_if(~outdated).alias("n_fresh"))


def priority_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = loaded_lines(table(spark, sf_dir, "raw_lines"), "entry")
    value = records.parsed_priority(F.col("priority"))
    return rows.select("line_id", value.alias("parsed"), records.priority_text(value).alias("shown"))


def priority_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = (F.col("value") / 100 - 0.25).cast("float")
    return table(spark, sf_dir, "events").select("event_id", records.clamped_priority(value).alias("clamped"), records.priority(value).alias("valid"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a host and location of the snapshots."""
    rows = table(spark, sf_dir, "entry_snapshots").where("loc is not null")
    return rows.groupBy("host_id", "loc").agg(
        F.max("lastmod").cast("timestamp").alias("lastmod"), F.max("lastmod_offset_min").alias("lastmod_offset_min"),
        F.max("priority").alias("priority"), F.max(records.frequency(F.col("changefreq"))).alias("changefreq"),
    )


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "index_listings").where("loc is not null").groupBy("host_id", "loc")
    return rows.agg(F.max("fetched_at").cast("timestamp").alias("lastmod"), F.lit(None).cast("int").alias("lastmod_offset_min"))


def sitemap_txt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.plain_sitemaps(entries(spark, sf_dir).select("host_id", "loc"))


def sitemap_xml_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.entry_sitemaps(entries(spark, sf_dir))


def sitemap_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.index_sitemaps(indexes(spark, sf_dir))


def sitemap_txt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.plain_records(sitemap_txt_build(spark, sf_dir), "host_id", "txt")


def sitemap_xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.xml_records(sitemap_xml_build(spark, sf_dir), "urlset", "host_id", "xml")
    return rows.select("host_id", "loc", F.coalesce(F.unix_micros("lastmod"), F.lit(0).cast("long")).alias("lastmod_us"), F.coalesce("lastmod_offset_min", F.lit(0)).alias("lastmod_offset_min"), "priority", "changefreq")


def sitemap_index_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.xml_records(sitemap_index_build(spark, sf_dir), "sitemapindex", "host_id", "xml")
    return rows.select("host_id", "loc", F.unix_micros("lastmod").alias("lastmod_us"))


def sitemap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of built files, and of texts that are no sitemaps."""
    built = [sitemap_txt_build(spark, sf_dir).select(F.col("txt").alias("c")), sitemap_xml_build(spark, sf_dir).select(F.col("xml").alias("c")), sitemap_index_build(spark, sf_dir).select(F.col("xml").alias("c"))]
    texts = table(spark, sf_dir, "documents").select(F.col("text").alias("c"))
    whole = built[0].unionByName(built[1]).unionByName(built[2]).unionByName(texts)
    return whole.select(parse.kind(F.encode("c", "UTF-8")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def sitemap_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "hosts").select("host_id", F.col("host").alias("_name"))
    documents = build.site(entries(spark, sf_dir).join(hosts, "host_id"), "host_id", "_name")
    documents = materialise(documents.select("url", F.encode("content", "UTF-8").alias("content")), "sites")
    roots = hosts.select(F.concat(F.lit("https://"), "_name", F.lit("/sitemap-index.xml")).alias("url"))
    return parse.expand(roots, documents).select("root", "loc")


def sitemap_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of all hosts against the files of those that can be reached."""
    hosts = table(spark, sf_dir, "hosts").select("host_id", F.col("host").alias("_name"), policy.access_label(F.col("access_result")).alias("_access"))
    there = entries(spark, sf_dir).join(hosts.where("not _access <=> 'Unreachable'").drop("_access"), "host_id")
    documents = materialise(build.site(there, "host_id", "_name").select("url", F.encode("content", "UTF-8").alias("content")), "sites")
    roots = hosts.select(F.concat(F.lit("https://"), "_name", F.lit("/sitemap-index.xml")).alias("url"))
    return parse.missing(roots, documents)


def sitemap_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each host against a limit of 5 records and 500 bytes."""
    built = [sitemap_txt_build(spark, sf_dir).select("host_id", F.lit("plain").alias("sort"), F.col("txt").alias("c")), sitemap_xml_build(spark, sf_dir).select("host_id", F.lit("urlset").alias("sort"), F.col("xml").alias("c"))]
    files = built[0].unionByName(built[1]).select(F.struct("host_id", "sort").alias("url"), F.encode("c", "UTF-8").alias("content"))
    return parse.over_limits(files, record_limit=5, byte_limit=500).select("url.host_id", "url.sort", "error", "over")


def sitemap_damaged_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a host from its entries, each record damaged in one of six ways by its place: what is still read."""
    rows = entries(spark, sf_dir).select("host_id", "loc", (F.row_number().over(Window.partitionBy("host_id").orderBy("loc")) - 1).alias("at"))
    loc = records.escape(F.col("loc"))
    texts = [
        F.concat(F.lit("<url>\n <loc>"), loc, F.lit("</loc>\n</url>")), F.concat(F.lit("<url><loc><![CDATA["), F.col("loc"), F.lit("]]></loc></url>")),
        F.concat(F.lit("<URL><loc>"), loc, F.lit("</loc></URL>")), F.concat(F.lit("<url><loc>"), loc, F.lit("&nope;</loc></url>")),
        F.concat(F.lit("<!-- <url> --><url><lastmod>x</lastmod><loc>https://first.example/</loc><loc>"), loc, F.lit("</loc><x:y><loc>no</loc></x:y></url>")),
        F.concat(F.lit("<url><loc/><priority>2</priority></url>")),
    ]
    text = F.element_at(F.array(*texts), F.pmod("at", F.lit(6)).cast("int") + 1)
    files = rows.groupBy("host_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("t")))), lambda r: r["t"]), "").alias("_all"))
    documents = files.select("host_id", F.encode(F.concat(F.lit('<?xml version="1.0"?><!-- <sitemapindex> --><UrlSet>'), "_all", F.lit("</UrlSet>")), "UTF-8").alias("xml"))
    return parse.xml_records(documents, "urlset", "host_id", "xml").select("host_id", "loc")


def bytes_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line of the plain lists the bytes that are read with it."""
    lines = sitemap_txt_build(spark, sf_dir).select("host_id", F.posexplode(F.split(F.regexp_replace("txt", "\n$", ""), "\n")).alias("pos", "line"))
    return counting.consumed(lines, "host_id", "pos", "line").select("host_id", "pos", "consumed")


def priority_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries made from locations and priorities; those without a valid one have the average one."""
    made = records.entry(F.col("loc"), priority=records.effective_priority(F.col("priority")))
    rows = table(spark, sf_dir, "entry_listings").select("entry_id", made.alias("e")).where("e is not null")
    return rows.select("entry_id", "e.loc", "e.priority", (F.col("e.priority") >= records.MOST_PRIORITY).alias("most"))


def sitemap_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small limits, to see them hold: of each host the records and bytes, and whether every file is within both."""
    rows = build.sharded(entries(spark, sf_dir).select("host_id", "loc"), "host_id", F.octet_length("loc") + 1, 100, 4_000)
    files = rows.groupBy("host_id", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("loc") + 1).alias("b"))
    within = F.bool_and((F.col("n") <= 100) & (F.col("b") <= 4_000)).alias("within")
    return files.groupBy("host_id").agg(F.sum("n").alias("records"), F.sum("b").alias("bytes"), within)


def byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.byte_counts(table(spark, sf_dir, "documents"), F.coalesce("source", F.lit("none")), F.col("text"), F.col("agenda_item"))


QUERIES = {
    q.__name__: q
    for q in (
        freq_next, freq_outdated, priority_parse, priority_clamp, sitemap_txt_build, sitemap_xml_build, sitemap_index_build, sitemap_txt_parse,
        sitemap_xml_parse, sitemap_index_parse, sitemap_detect, sitemap_auto, sitemap_limits, byte_counts, sitemap_missing, sitemap_over_limit,
        sitemap_damaged_parse, bytes_consumed, priority_default,
    )
}

_FREQ = "CASE WHEN lower(trim(changefreq)) IN ('always', 'hourly', 'daily', 'weekly', 'monthly', 'yearly', 'never') THEN lower(trim(changefreq)) END"
_HOURS = "CASE c WHEN 'hourly' THEN 1 WHEN 'daily' THEN 24 WHEN 'weekly' THEN 168 WHEN 'monthly' THEN 720 WHEN 'yearly' THEN 8760 END"
_ENTRIES = f"""WITH entries AS (SELECT host_id, loc, max(lastmod) AS lastmod, max(lastmod_offset_min) AS off, max(priority) AS priority, max({_FREQ}) AS changefreq FROM entry_snapshots WHERE loc IS NOT NULL GROUP BY host_id, loc),
indexes AS (SELECT host_id, loc, max(fetched_at) AS lastmod, 0 AS off FROM index_listings WHERE loc IS NOT NULL GROUP BY host_id, loc)
"""
_XML = "replace(replace(replace(replace(replace(loc, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '\"', '&quot;')"
_MOD = """strftime((lastmod AT TIME ZONE 'UTC') + to_minutes(coalesce(off, 0)::BIGINT), '%Y-%m-%dT%H:%M:%S.') || lpad((date_part('microseconds', lastmod)::BIGINT % 1000000 // 10000)::VARCHAR, 2, '0') ||
  CASE WHEN coalesce(off, 0) = 0 THEN 'Z' ELSE (CASE WHEN off < 0 THEN '-' ELSE '+' END) || lpad((abs(off) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(off) % 60)::VARCHAR, 2, '0') END"""
_HEAD = 'chr(65279) || \'<?xml version="1.0" encoding="UTF-8"?><{0} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\''
_CENTI = "epoch_us(lastmod) // 10000 * 10000"


def _loc(c: str = "loc") -> str:
    """A tidy location as a parsed one: scheme and host in lower case, the rest encoded."""
    return rf"lower(regexp_extract({c}, '(?i)^https?://[^/?#]*')) || {norm_sql(path_sql(c))}"


ORACLES = {
    "freq_next": f"SELECT delivery_id, loc, c AS changefreq, epoch_us(lastmod + to_hours(({_HOURS})::INT)) AS next_us FROM (SELECT delivery_id, loc, lastmod, {_FREQ} AS c FROM entry_snapshots) WHERE lastmod IS NOT NULL AND c NOT IN ('always', 'never')",
    "freq_outdated": f"""WITH r AS (SELECT delivery_id, CASE c WHEN 'always' THEN true WHEN 'never' THEN false ELSE lastmod + to_hours(({_HOURS})::INT) <= TIMESTAMPTZ '{NOW}+00' END AS o FROM (SELECT delivery_id, lastmod, {_FREQ} AS c FROM entry_snapshots))
SELECT delivery_id, count(*) FILTER (o) AS n_outdated, count(*) FILTER (NOT o) AS n_fresh FROM r GROUP BY ALL""",
    "priority_parse": _LINES + r""", p AS (SELECT line_id, CASE WHEN regexp_full_match(f[3], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(f[3] AS FLOAT) END AS v FROM judged WHERE reason IS NULL AND feed = 'entry'),
q AS (SELECT line_id, CASE WHEN v BETWEEN 0 AND 1 THEN v END AS parsed FROM p) SELECT line_id, parsed, format('{:.1f}', parsed) AS shown FROM q""",
    "priority_clamp": "WITH v AS (SELECT event_id, (value / 100 - 0.25)::FLOAT AS v FROM events) SELECT event_id, CASE WHEN v IS NULL THEN NULL WHEN isnan(v) THEN 0::FLOAT ELSE least(greatest(v, 0::FLOAT), 1::FLOAT) END AS clamped, CASE WHEN NOT isnan(v) AND v BETWEEN 0 AND 1 THEN v END AS valid FROM v",
    "sitemap_txt_build": _ENTRIES + "SELECT host_id, '0-0' AS shard, count(*) AS records, string_agg(loc || chr(10), '' ORDER BY loc) AS txt FROM entries GROUP BY host_id",
    "sitemap_xml_build": _ENTRIES + f"""SELECT host_id, '0-0' AS shard, count(*) AS records, {_HEAD.format("urlset")} || string_agg('<url><loc>' || {_XML} || '</loc>' || coalesce('<lastmod>' || {_MOD} || '</lastmod>', '')
  || coalesce('<priority>' || format('{{:.1f}}', priority) || '</priority>', '') || coalesce('<changefreq>' || changefreq || '</changefreq>', '') || '</url>', '' ORDER BY loc) || '</urlset>' AS xml FROM entries GROUP BY host_id""",
    "sitemap_index_build": _ENTRIES + f"""SELECT host_id, '0-0' AS shard, count(*) AS records, {_HEAD.format("sitemapindex")} || string_agg('<sitemap><loc>' || {_XML} || '</loc>' || coalesce('<lastmod>' || {_MOD} || '</lastmod>', '') || '</sitemap>', '' ORDER BY loc) || '</sitemapindex>' AS xml FROM indexes GROUP BY host_id""",
    "sitemap_txt_parse": _ENTRIES + f"SELECT host_id, (row_number() OVER (PARTITION BY host_id ORDER BY loc) - 1)::INT AS pos, {_loc()} AS loc FROM entries",
    "sitemap_xml_parse": _ENTRIES + f"SELECT host_id, {_loc()} AS loc, coalesce({_CENTI}, 0)::BIGINT AS lastmod_us, CASE WHEN lastmod IS NOT NULL THEN coalesce(off, 0)::INT ELSE 0 END AS lastmod_offset_min, format('{{:.1f}}', priority)::FLOAT AS priority, changefreq FROM entries",
    "sitemap_index_parse": _ENTRIES + f"SELECT host_id, {_loc()} AS loc, ({_CENTI})::BIGINT AS lastmod_us FROM indexes",
    "sitemap_detect": _ENTRIES + """SELECT kind, count(*) AS n FROM (SELECT DISTINCT host_id, 'plain' AS kind FROM entries UNION ALL SELECT DISTINCT host_id, 'urlset' FROM entries UNION ALL SELECT DISTINCT host_id, 'sitemapindex' FROM indexes
  UNION ALL SELECT 0, CASE WHEN trim(text, ' ') <> '' AND NOT regexp_matches(text, '^[\\s]*<[A-Za-z:]') THEN 'plain' END FROM documents) GROUP BY ALL""",
    "sitemap_auto": _ENTRIES + f"SELECT 'https://' || host || '/sitemap-index.xml' AS root, {_loc()} AS loc FROM entries JOIN hosts USING (host_id)",
    "sitemap_limits": _ENTRIES + "SELECT host_id, count(*) AS records, sum(strlen(loc) + 1)::BIGINT AS bytes, true AS within FROM entries GROUP BY ALL",
    "byte_counts": "SELECT *, reader_bytes + writer_bytes AS total_bytes FROM (SELECT coalesce(source, 'none') AS source, coalesce(sum(strlen(text)), 0)::BIGINT AS reader_bytes, coalesce(sum(strlen(agenda_item)), 0)::BIGINT AS writer_bytes FROM documents GROUP BY ALL)",
    "sitemap_missing": _ENTRIES + """SELECT 'https://' || host || '/sitemap-index.xml' AS root, 'https://' || host || '/sitemap-index.xml' AS url, 'missing' AS error FROM hosts
  WHERE lower(access_result) IS NOT DISTINCT FROM 'unreachable' OR host_id NOT IN (SELECT host_id FROM entries)""",
    "sitemap_damaged_parse": _ENTRIES + f"SELECT host_id, {_loc()} AS loc FROM (SELECT host_id, loc, row_number() OVER (PARTITION BY host_id ORDER BY loc) - 1 AS k FROM entries) WHERE k % 6 IN (0, 4)",
    "bytes_consumed": _ENTRIES + "SELECT host_id, (row_number() OVER w - 1)::INT AS pos, (sum(strlen(loc) + 1) OVER w)::BIGINT AS consumed FROM entries WINDOW w AS (PARTITION BY host_id ORDER BY loc)",
    "priority_default": "SELECT entry_id, loc, CASE WHEN priority BETWEEN 0 AND 1 AND NOT isnan(priority) THEN priority::FLOAT ELSE 0.5::FLOAT END AS priority, coalesce(priority = 1, false) AS most FROM entry_listings WHERE loc IS NOT NULL",
}
_files = {k: ORACLES[k].removeprefix(_ENTRIES) for k in ("sitemap_txt_build", "sitemap_xml_build")}
ORACLES["sitemap_over_limit"] = _ENTRIES + f""", f AS (SELECT host_id, 'plain' AS sort, records, strlen(txt) AS b FROM ({_files["sitemap_txt_build"]}) UNION ALL SELECT host_id, 'urlset', records, strlen(xml) FROM ({_files["sitemap_xml_build"]}))
SELECT host_id, sort, 'EntryLimit' AS error, (records - 5)::BIGINT AS over FROM f WHERE records > 5 UNION ALL SELECT host_id, sort, 'ByteLimit', (b - 500)::BIGINT FROM f WHERE b > 500"""
