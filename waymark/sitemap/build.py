"""Sitemap documents from records, cut into files within the protocol's limits.

Records of a host with more than a file's worth of them are first spread by a hash of their location, so that no task has
to number or render the records of a large host alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.sitemap.records import BYTE_LIMIT, RECORD_LIMIT, escape, lastmod_text, priority_text

# What stands before a sitemap in XML, and its namespace.
_PROLOG = "\ufeff<?xml version=\"1.0\" encoding=\"UTF-8\"?>"
_SPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"


def _tag(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))


def entry_xml() -> Column:
    """One <url> of columns loc, lastmod, lastmod_offset_min, priority, changefreq; null fields are left out."""
    parts = [
        _tag("loc", escape(F.col("loc"))), _tag("lastmod", lastmod_text(F.col("lastmod"), F.col("lastmod_offset_min"))),
        _tag("priority", priority_text(F.col("priority"))), _tag("changefreq", F.col("changefreq")),
    ]
    return _tag("url", F.concat_ws("", *parts))


def index_xml() -> Column:
    """One <sitemap> of columns loc, lastmod, lastmod_offset_min."""
    return _tag("sitemap", F.concat_ws("", _tag("loc", escape(F.col("loc"))), _tag("lastmod", lastmod_text(F.col("lastmod"), F.col("lastmod_offset_min")))))


def sharded(records: DataFrame, key: str, size: Column, record_limit: int = RECORD_LIMIT, byte_limit: int = BYTE_LIMIT) -> DataFrame:
    """records with shard (text) and its number of the record in it (at), at most record_limit and byte_limit of a size each.

    A file takes the records that end within a stretch that is shorter than byte_limit by the largest record, so that one
    that begins before the stretch fits too. A record over byte_limit fits in no file."""
    largest = F.max(F.when(size <= byte_limit, size))
    counts = records.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_bytes"), (byte_limit + 1 - F.coalesce(largest, F.lit(1))).alias("_stretch"))
    parts = F.greatest(F.ceil(F.col("_n") / (0.8 * record_limit)), F.ceil(F.col("_bytes") / (0.8 * byte_limit)), F.lit(1))
    rows = records.join(counts.select(key, parts.alias("_parts"), "_stretch"), key).withColumn("_part", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("loc"), "_parts")).otherwise(0))
    order = Window.partitionBy(key, "_part").orderBy("loc", *[F.col(c) for c in ("lastmod", "priority", "changefreq") if c in records.columns])
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    number = F.row_number().over(order) - 1
    rows = rows.withColumns({"_at": number, "_sum": F.sum(size).over(so_far)})
    over = F.floor(F.col("_at") / record_limit) + F.floor((F.col("_sum") - 1) / F.col("_stretch"))  # a new file where either rises
    return rows.withColumn("shard", F.concat_ws("-", "_part", over.cast("string"))).withColumnRenamed("_at", "at").drop("_parts", "_part", "_sum", "_stretch")


def _rendered(rows: DataFrame, key: str) -> DataFrame:
    """A file holds at most RECORD_LIMIT records."""
    return rows.groupBy(key, "shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "_text"))), lambda r: r["_text"]).alias("_all"), F.count(F.lit(1)).alias("records"))


def plain_sitemaps(records: DataFrame, key: str = "host_id") -> DataFrame:
    """key, shard, records, txt: a line a location."""
    rows = sharded(records.where("loc is not null").withColumn("_text", F.concat("loc", F.lit("\n"))), key, F.octet_length("_text"))
    return _rendered(rows, key).select(key, "shard", "records", F.array_join("_all", "").alias("txt"))


def _document(rows: DataFrame, key: str, root: str) -> DataFrame:
    begin, end = f'{_PROLOG}<{root} xmlns="{_SPACE}">', f"</{root}>"
    limit = BYTE_LIMIT - len(begin.encode()) - len(end)
    return _rendered(sharded(rows, key, F.octet_length("_text"), byte_limit=limit), key).select(
        key, "shard", "records", F.concat(F.lit(begin), F.array_join("_all", ""), F.lit(end)).alias("xml")
    )


def entry_sitemaps(records: DataFrame, key: str = "host_id") -> DataFrame:
    """key, shard, records, xml: URL sets."""
    return _document(records.where("loc is not null").withColumn("_text", entry_xml()), key, "urlset")


def index_sitemaps(records: DataFrame, key: str = "host_id") -> DataFrame:
    """key, shard, records, xml: indexes of sitemaps."""
    return _document(records.where("loc is not null").withColumn("_text", index_xml()), key, "sitemapindex")


def site(records: DataFrame, key: str, host: str) -> DataFrame:
    """url, content of all files of each host: its URL sets and one index of them. host names the column with the host."""
    sets = entry_sitemaps(records.drop(host), key)
    names = records.select(key, host).where(F.col(host).isNotNull()).groupBy(key).agg(F.min(host).alias("_host"))
    sets = sets.join(names, key).withColumn("url", F.concat(F.lit("https://"), "_host", F.lit("/sitemap-"), "shard", F.lit(".xml")))
    listed = sets.select(key, "_host", F.col("url").alias("loc"), F.lit(None).cast("timestamp").alias("lastmod"), F.lit(None).cast("int").alias("lastmod_offset_min"))
    index = index_sitemaps(listed.drop("_host"), key).join(names, key)
    # more than one file of index only for hosts with over RECORD_LIMIT files
    at = F.when(F.col("shard") == "0-0", "").otherwise(F.concat(F.lit("-"), "shard"))
    index = index.select(F.concat(F.lit("https://"), "_host", F.lit("/sitemap-index"), at, F.lit(".xml")).alias("url"), F.col("xml").alias("content"))
    return sets.select("url", F.col("xml").alias("content")).unionByName(index)
