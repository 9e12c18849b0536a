"""Which of several copies of a call counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import dedup_identity


def _keyless() -> Column:
    return F.coalesce(F.col("dk"), F.lit("")) == ""


def _spread(alone: Column, order: str) -> Column:
    """Part of a window's key: rows that stand alone are dealt by their own id, so they never meet in one task."""
    return F.when(alone, F.col(order))


def dedup_first_wins(records: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each identity in ``order``, whose last column tells rows apart; rows without an identity stay. One pass."""
    marked = records.withColumn("ident", dedup_identity())
    alone = F.col("ident").isNull()
    first = Window.partitionBy("ident", _spread(alone, order[-1])).orderBy(*order)
    return marked.withColumn("rn", F.row_number().over(first)).where((F.col("rn") == 1) | alone).drop("rn", "ident")


def dedup_merged(records: DataFrame, order: str = "rid") -> DataFrame:
    """The lowest id of each (account, key); rows without a key stay. One pass."""
    first = Window.partitionBy("account_uuid", "dk", _spread(_keyless(), order)).orderBy(order)
    return records.withColumn("rn", F.row_number().over(first)).where((F.col("rn") == 1) | _keyless()).drop("rn")


def dedup_flag(records: DataFrame, order: str = "rid") -> DataFrame:
    """``is_dup`` for every row, so that reports need no dedup shuffle of their own."""
    least = F.min(order).over(Window.partitionBy("account_uuid", "dk", _spread(_keyless(), order)))
    return records.withColumn("is_dup", ~_keyless() & (F.col(order) != least))


def dedup_flag_incremental(flagged: DataFrame, arrived: DataFrame, order: str = "rid") -> DataFrame:
    """Flags after ``arrived`` rows joined: only keys they touch are worked out again."""
    keys = arrived.where(~_keyless()).select("account_uuid", "dk").distinct()
    stored = flagged.drop("is_dup")
    touched = stored.join(keys, ["account_uuid", "dk"], "left_semi")
    rest = flagged.join(keys, ["account_uuid", "dk"], "left_anti")
    return dedup_flag(touched.unionByName(arrived), order).select(*flagged.columns).unionByName(rest)
