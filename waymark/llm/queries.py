"""Queries of this package over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.format_copies import collapse_formats, format_groups
from waymark.llm.mixing import mixed, shares
from waymark.llm.subjects import assigned, composition
from waymark.llm.tokens import token_ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_groups(table(spark, sf_dir, "entry_listings"), "entry_id", "loc")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_formats(table(spark, sf_dir, "entry_listings"), "entry_id", "loc")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_ids(spark, F.col("text")).alias("ids"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return shares(mixed(table(spark, sf_dir, "documents"), targets), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = table(spark, sf_dir, "subject_areas").groupBy("subject").agg(F.min("about").alias("about")).orderBy("subject").collect()  # a fixed dozen
    return assigned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), [r.subject for r in areas], [r.about for r in areas])


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition(p8_found(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_areas"))


QUERIES = {q.__name__: q for q in (p3_found, p3_counts, p6_ids, p7_mix, p7_shares, p8_found, p8_composition)}
_KEYED = r"""
WITH cut AS (SELECT entry_id, lower(CASE WHEN strpos(loc, '?') > 0 THEN left(loc, strpos(loc, '?') - 1) ELSE loc END) AS path,
  lower(CASE WHEN strpos(loc, '?') > 0 THEN substr(loc, strpos(loc, '?') + 1) ELSE '' END) AS query FROM entry_listings WHERE loc IS NOT NULL),
keyed AS (SELECT entry_id, trim(regexp_replace(path, '[^\p{L}\p{N}]+', ' ', 'g')) || '?' ||
  array_to_string(list_sort(list_filter(list_transform(string_split(replace(query, ';', '&'), '&'), lambda f: trim(regexp_replace(f, '[^\p{L}\p{N}]+', ' ', 'g'))), lambda f: f <> '')), '&') AS key FROM cut)
"""
ORACLES = {
    "p3_found": _KEYED + "SELECT * FROM (SELECT min(entry_id) OVER (PARTITION BY key) AS first_id, entry_id AS copy_id FROM keyed) WHERE first_id < copy_id",
    "p3_counts": _KEYED + "SELECT min(entry_id) AS first_id, count(*) AS n_copies FROM keyed GROUP BY key",
}
