"""What a call cost: the price in force for its model, then the logged or computed cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, call_cost, tokens
from ..functions.names import is_free
from .asof import asof_join, intervals, small

RATE_COLUMNS = ("effective", "ri", "ro", "rc", "rr", "ri2", "ro2", "rc2", "rr2")


def price_intervals(models: DataFrame, periods: DataFrame) -> DataFrame:
    """(model, from_us, to_us, rates) for distinct models.

    In a period an exact name beats a substring either way, then the listed order; between
    periods the newest that names the model at all wins. Models times periods is a small table.
    """
    m, p = F.col("model"), F.col("pm")
    named = models.join(small(periods), (m == p) | m.contains(p) | p.contains(m))
    best = Window.partitionBy("model", "from_us").orderBy((m == p).desc(), "ord")
    one = named.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")
    return intervals(one, ["model"])


def asof_price(records: DataFrame, dim: DataFrame) -> DataFrame:
    """Records with the rates in force at their time, null where none names the model; ``dim`` as of ``price_intervals``."""
    return asof_join(records, dim.select("model", "from_us", "to_us", *RATE_COLUMNS), ["model"]).drop("from_us", "to_us")


def computed_cost() -> Column:
    """0 for free and unpriced models."""
    zero = F.lit(0).cast(MONEY)
    return F.when(is_free(F.col("model")), zero).otherwise(F.coalesce(call_cost(), zero))


def effective_cost() -> Column:
    """The logged cost, 0 included, before the computed one."""
    return F.coalesce(F.col("log_cost").cast(MONEY), F.col("computed"))


def price_calls(records: DataFrame, dim: DataFrame) -> DataFrame:
    """Records with ``computed``, ``cost`` and ``tokens``; rate columns dropped but for ``effective``."""
    priced = asof_price(records, dim).withColumn("computed", computed_cost())
    return priced.withColumn("cost", effective_cost()).withColumn("tokens", tokens()).drop(*RATE_COLUMNS[1:])
