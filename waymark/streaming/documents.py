"""New documents as they arrive. Reading a document needs no state, so no watermark either."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.robots.lexer import lex
from waymark.sitemap.parse import xml_records

FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_documents(spark: SparkSession, path: str, pattern: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """url and content of each file that appears under path."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
    return stream.load(path).select(F.col("path").alias("url"), "content")


def stream_directives(documents: DataFrame) -> DataFrame:
    """robots_id, pos, kind, value of each line of the robots documents that arrive."""
    return lex(documents.withColumnRenamed("url", "robots_id"))


def stream_entries(documents: DataFrame) -> DataFrame:
    """The entries of the URL sets that arrive."""
    return xml_records(documents, "urlset")
