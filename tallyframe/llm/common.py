"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that end a word in most contracts: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode, where none is set, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tallyframe-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint if the rows, counted up to the bound, don't exceed it; else the plain frame, to be shuffled."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is quick and exact on ASCII; other texts are translated."""
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, up, up.lower()))


def space_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null and blank texts have none."""
    t = F.btrim(text, F.lit(SPACES))
    return F.when(t != "", F.split(t, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equally named keys where null equals null; the right keys are dropped."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], out: str, per_bucket: int = 20_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps and without gathering a group in one task.

    Rows fall into hash buckets of about ``per_bucket`` rows; a running sum over the bucket
    counts gives each bucket's first number, and a row number inside the bucket the rest.
    ``df`` is read three times, so hand in a materialized one. ``order`` must tell rows apart
    where the numbers have to be repeatable; full ties are numbered in any order.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    salted = null_safe(df, sizes, keys, "inner").withColumn(
        "__bucket", F.pmod(F.xxhash64(*order), F.ceil(F.col("__size") / F.lit(per_bucket)).cast("long"))
    ).drop("__size")
    counts = salted.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    ranked = salted.withColumn("__i", F.row_number().over(inside) - 1)
    return (
        null_safe(ranked, starts, [*keys, "__bucket"], "inner")
        .withColumn(out, (F.col("__start") + F.col("__i")).cast("long"))
        .drop("__start", "__i", "__bucket")
    )
