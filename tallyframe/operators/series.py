"""Dense axes and what is laid on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dense_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    days = F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    return spark.range(1).select(days.alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))


def on_axis(axis: DataFrame, values: DataFrame, at: str, trace: str) -> DataFrame:
    """Every (axis point, trace), null where there is no value. The axis has a bounded number of points."""
    full = values.select(trace).distinct().join(F.broadcast(axis), F.lit(True))
    return full.join(values, [at, trace], "left")


def covered_axis(rows: DataFrame, day: str = "day") -> DataFrame:
    """The days from the first to the last that has a row."""
    d = F.to_date(day)
    span = rows.agg(F.min(d).alias("a"), F.max(d).alias("z")).where("a IS NOT NULL")
    return span.select(F.explode(F.sequence("a", "z")).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))


def fill_curve(samples: DataFrame, start_us: int, step_us: int, n: int) -> DataFrame:
    """Per machine the last reading in each step; null, not 0, where none fell."""
    last = samples.groupBy("machine_id", F.floor((F.col("ts_us") - start_us) / step_us).cast("long").alias("bucket")).agg(F.max_by("used_pct", F.struct("ts_us", "event_id")).alias("pct"))
    axis = samples.sparkSession.range(n).withColumnRenamed("id", "bucket")
    return on_axis(axis, last, "bucket", "machine_id").select("machine_id", "bucket", "pct")
