"""Money and token expressions. Money is decimal until it leaves a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: tokens of one kind in a call from which on its higher rate holds.
TIER_TOKENS = 200_000
KINDS = ("input_tokens", "output_tokens", "cache_create", "cache_read")
RATES = ("ri", "ro", "rc", "rr")
MONEY = "decimal(30,10)"


def tokens() -> Column:
    """All tokens of a call."""
    return F.col("input_tokens") + F.col("output_tokens") + F.col("cache_create") + F.col("cache_read")


def tiered_cost(count: Column, rate: Column, above: Column) -> Column:
    """The part over the tier pays its own rate where one exists; each kind of token tiers alone."""
    n = count.cast("decimal(15,0)")
    tier = F.lit(TIER_TOKENS).cast("decimal(15,0)")
    return F.when((count > TIER_TOKENS) & above.isNotNull(), tier * rate + (count - TIER_TOKENS).cast("decimal(15,0)") * above).otherwise(n * rate)


def call_cost() -> Column:
    """Sum over the four kinds, from rate columns ri .. rr2; null without a price."""
    parts = [tiered_cost(F.col(k), F.col(r), F.col(f"{r}2")) for k, r in zip(KINDS, RATES)]
    return (parts[0] + parts[1] + parts[2] + parts[3]).cast(MONEY)


def usd(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b, null where b is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


#: Fixed value: the factor of Norwegian value-added tax.
VAT = "1.25"


def converted(cost: Column, rate: Column, vat: bool = True) -> Column:
    """Kroner at a day's rate, with tax unless it is left out."""
    return cost * rate * F.lit(VAT).cast("decimal(3,2)") if vat else cost * rate
