"""Bytes read and written, as columns and as metrics of a running job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def observed(df: DataFrame, read: Column | None = None, written: Column | None = None, start: tuple[int, int] = (0, 0)) -> tuple[DataFrame, Observation]:
    """df, and an observation of reader_bytes, writer_bytes and total_bytes that is filled when df is computed.

    The counters begin at start; null values have no bytes."""
    counter = Observation()
    sums = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) if c is not None else F.lit(0) for c in (read, written)]
    r, w = sums[0] + start[0], sums[1] + start[1]
    first = F.count(F.lit(1)) * 0  # an observation needs an aggregate in each metric
    return df.observe(counter, (r + first).alias("reader_bytes"), (w + first).alias("writer_bytes"), (r + w + first).alias("total_bytes")), counter


def byte_counts(df: DataFrame, source: Column, read: Column, written: Column) -> DataFrame:
    """source, reader_bytes, writer_bytes, total_bytes."""
    sums = df.groupBy(source.alias("source")).agg(
        F.coalesce(F.sum(F.octet_length(read)), F.lit(0)).cast("long").alias("reader_bytes"),
        F.coalesce(F.sum(F.octet_length(written)), F.lit(0)).cast("long").alias("writer_bytes"),
    )
    return sums.withColumn("total_bytes", F.col("reader_bytes") + F.col("writer_bytes"))


def consumed(df: DataFrame, key: str, order: str, text: str, ends: int = 1) -> DataFrame:
    """df with `consumed`: the bytes of a document that are read once a line of it is, with `ends` bytes for each line break.

    key names the document, order the line's place; a document is read by one task, as its lines depend on each other."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("consumed", F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + ends).over(so_far))
