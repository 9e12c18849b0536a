"""Merging batches of files and samples into stored tables, and reading what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_free, is_pseudo
from ..operators.asof import small

FINGERPRINT = ["file_path", "mtime_ns", "size"]


def file_verdicts(records: DataFrame, incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(machine_id, file_path, verdict). ``records`` carry ``effective``, the price period in force or null.

    An equal fingerprint is skipped; one unpriced call rejects its file; the others are accepted.
    """
    unpriced = F.col("effective").isNull() & ~is_free(F.col("model")) & ~is_pseudo(F.col("model"))
    files = records.groupBy("machine_id", "file_path").agg(F.bool_or(unpriced).alias("unpriced"))
    same = incoming.join(stored, FINGERPRINT, "left_semi").select("file_path", F.lit(True).alias("same"))
    x = files.join(same, "file_path", "left")
    return x.select("machine_id", "file_path", F.when(F.col("same"), "skipped").when(F.col("unpriced"), "rejected").otherwise("accepted").alias("verdict"))


def replace_files(stored: DataFrame, batch: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Accepted files' rows are replaced whole, whatever their age."""
    accepted = small(verdicts.where("verdict = 'accepted'").select("machine_id", "file_path"))
    keys = ["machine_id", "file_path"]
    return stored.join(accepted, keys, "left_anti").unionByName(batch.join(accepted, keys, "left_semi"))


def upsert(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last write of each key."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def changed_files(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose fingerprint isn't among the stored ones."""
    return live.join(stored, FINGERPRINT, "left_anti")


def orphans(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Records of files that are gone: they stay, behind live files in dedup order."""
    return stored.join(live.select("file_path").distinct(), "file_path", "left_anti")


def replace_timeline(stored: DataFrame, declared: DataFrame, account: str) -> DataFrame:
    """One account's declared rows replaced whole; declared times that another row holds are left out, so captures stay."""
    kept = stored.where(~((F.col("source") == "backfill") & (F.col("account_uuid") == account)))
    return kept.unionByName(declared.join(kept.select("ts_us"), "ts_us", "left_anti").select(*kept.columns))
