"""Documents from and to files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.robots.lexer import LIMIT


def read_documents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """url (the file's path), content, length of each file under path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("url"), "content", "length")


def read_robots(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """robots_id (the file's path) and content, cut at the limit, of each file under path."""
    return read_documents(spark, path, pattern).select(F.col("url").alias("robots_id"), F.substring("content", 1, LIMIT).alias("content"))


def write_documents(documents: DataFrame, path: str, name: str = "name", content: str = "content") -> tuple[int, int]:
    """A file of exactly the content's bytes for each row, under path; how many files and bytes were written.

    content is text or binary. Each file is written beside its place and then moved there, so that a task that is run again
    replaces what it wrote. Rows with a null name or content are left out; of rows with one name any stays. The file system
    is that of the path's scheme, a local path where it has none."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        for batch in batches:
            sizes = []
            for file, data in zip(batch["name"], batch["content"], strict=True):
                place = f"{root.rstrip('/')}/{file}"
                files.create_dir(place.rsplit("/", 1)[0], recursive=True)
                part = f"{place}.{uuid.uuid4().hex}.part"
                with files.open_output_stream(part) as out:
                    out.write(bytes(data))
                files.move(part, place)
                sizes.append(len(data))
            yield pd.DataFrame({"bytes": sizes})

    rows = documents.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content")).where("name is not null and content is not null")
    done = rows.mapInPandas(write, "bytes long").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return done.files, done.bytes
