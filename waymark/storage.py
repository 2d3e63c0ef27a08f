"""Where jobs keep intermediate tables: always a folder that every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # application -> its own folder, on a local master only


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir, or the checkpoint folder that the context was given).

    Where neither is set: a folder of its own for a local master, which has no other machine; an error on any cluster,
    whose executors would each write to a disk of their own. The session's settings are left as they are."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {context.master} share")
    application = context.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = f"file://{tempfile.mkdtemp(prefix='waymark-')}"
        _forget_at_end(spark, _LOCAL[application])
    return _LOCAL[application]


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _forget_at_end(spark: SparkSession, path: str) -> None:
    """The path goes when the driver's JVM ends: until then tables may be read lazily."""
    files, hadoop = _file_system(spark, path)
    files.deleteOnExit(hadoop)


def exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = _file_system(spark, path)
    return files.exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    files, hadoop = _file_system(spark, path)
    files.delete(hadoop, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses. It exists and is removed with the application."""
    path = f"{shared_dir(spark).rstrip('/')}/waymark-{label}-{uuid.uuid4().hex}"
    files, hadoop = _file_system(spark, path)
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends at files that outlive executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
