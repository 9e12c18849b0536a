"""Tables written once and read by later queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, tuple] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share; in local mode, where the session names none, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = mkdtemp(prefix="tallyframe-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The rows by way of the shared folder: worked out once, however often they are read."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version(spark: SparkSession, path: str) -> tuple:
    """Bytes, files and time of what lies at a path: changes when the input does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = files.getContentSummary(at)
    return path, summary.getLength(), summary.getFileCount(), files.getFileStatus(at).getModificationTime()


def stored(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """What ``build`` gives, written at the first call of a session and read from then on, until ``source`` changes."""
    key = (spark.sparkContext.applicationId, name, version(spark, source))
    if key not in _WRITTEN:
        df = build()
        path = shared_path(spark, name)
        df.write.partitionBy(*partition_by).parquet(path)
        _WRITTEN[key] = path, df.schema
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)
