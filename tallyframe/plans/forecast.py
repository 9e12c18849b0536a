"""Where spend is heading, and what a plan cost against what its use was worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import FOREVER, interval_overlap, small

HALF_LIFE_DAYS = 7
MIN_ACTIVE_DAYS = 3


def daily_costs(calls: DataFrame, upto_day: str | None = None) -> DataFrame:
    x = calls if upto_day is None else calls.where(F.col("day") <= upto_day)
    return x.groupBy("account_uuid", "day").agg(F.sum("cost").alias("cost"))


def _rate(today: str) -> tuple[Column, Column]:
    """``active`` days, those with any cost, and their weighted mean; null with fewer than three. A day's weight halves every week."""
    active, age = F.col("cost") > 0, F.greatest(F.datediff(F.lit(today), F.to_date("day")), F.lit(0))
    weight = F.when(active, F.pow(F.lit(2.0), -age / HALF_LIFE_DAYS))
    n = F.count_if(active)
    return n.alias("active"), F.when(n >= MIN_ACTIVE_DAYS, F.sum(F.col("cost").cast("double") * weight) / F.sum(weight)).alias("rate")


def daily_rate(daily: DataFrame, today: str) -> DataFrame:
    """(account_uuid, active, rate): recent daily spend over the days that had any, today among them."""
    return daily.groupBy("account_uuid").agg(*_rate(today))


def billing_start(day: Column, renewal: Column) -> Column:
    """The last renewal on or before a day; the renewal day clamps to a short month's end."""
    def on(month: Column) -> Column:
        return F.date_add(F.trunc(month, "month"), F.least(renewal, F.dayofmonth(F.last_day(month))) - 1)

    this = on(day)
    return F.when(this <= day, this).otherwise(on(F.add_months(F.trunc(day, "month"), -1)))


def billing_end(start: Column, renewal: Column) -> Column:
    month = F.add_months(F.trunc(start, "month"), 1)
    return F.date_add(month, F.least(renewal, F.dayofmonth(F.last_day(month))) - 1)


def period_forecast(daily: DataFrame, start: Column, end: Column, today: str) -> DataFrame:
    """Spent in [start, end), and that plus the period's own rate for the days that remain after today.

    ``daily`` carries whatever ``start`` and ``end`` refer to. An account without a rate in the
    period has no forecast and no row.
    """
    x = daily.withColumns({"__start": start, "__end": end, "__day": F.to_date("day")})
    inside = x.where((F.col("__day") >= F.col("__start")) & (F.col("__day") < F.col("__end")))
    elapsed, total = F.datediff(F.lit(today), F.max("__start")) + 1, F.datediff(F.max("__end"), F.max("__start"))
    each = inside.groupBy("account_uuid").agg(F.sum("cost").cast("double").alias("spent"), *_rate(today), elapsed.alias("elapsed"), total.alias("total"))
    remaining = F.greatest(F.col("total") - F.col("elapsed"), F.lit(0))
    return each.where(F.col("rate").isNotNull()).withColumn("forecast", F.col("spent") + F.col("rate") * remaining).drop("active", "rate")


def month_projection(calls: DataFrame, today: str, trailing_days: int = 14) -> DataFrame:
    """(spent, by_month, by_fortnight): the month to date over its days, and the whole days before today, both times the month's length.

    No row unless the newest month with calls is today's; both null on its last day; the second null without cost.
    """
    now, day = F.to_date(F.lit(today)), F.to_date("day")
    length, gone = F.dayofmonth(F.last_day(now)), F.dayofmonth(now)
    lately = (day >= F.date_sub(now, trailing_days)) & (day < now)
    s = calls.agg(
        F.max(day).alias("newest"), F.sum(F.when(day >= F.trunc(now, "month"), F.col("cost"))).cast("double").alias("spent"), F.sum(F.when(lately, F.col("cost"))).cast("double").alias("f")
    ).where(F.trunc("newest", "month") == F.trunc(now, "month"))
    runs = gone < length
    return s.select(
        "spent", F.when(runs, F.col("spent") / gone * length).alias("by_month"), F.when(runs & (F.col("f") > 0), F.col("f") / trailing_days * length).alias("by_fortnight")
    )


def stretches(tiers: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """[from_us, to_us) pieces of a span, cut at every declared change, gapless; null tiers before the first."""
    keys = tiers.select("account_uuid").distinct()
    edges = tiers.where((F.col("from_us") > start_us) & (F.col("from_us") < end_us)).select("account_uuid", F.col("from_us").alias("cut")).unionByName(keys.select("account_uuid", F.lit(start_us).alias("cut"))).distinct()
    w = Window.partitionBy("account_uuid").orderBy("cut")
    pieces = edges.withColumn("to_us", F.coalesce(F.lead("cut").over(w), F.lit(end_us))).withColumnRenamed("cut", "a_us")
    later = F.lead("from_us").over(Window.partitionBy("account_uuid").orderBy("from_us"))
    state = tiers.select("account_uuid", "from_us", F.coalesce(later, F.lit(FOREVER)).alias("until"), "seat_tier", "user_tier", "org_tier")
    s = state.withColumnRenamed("account_uuid", "u")
    return pieces.join(s, (pieces["account_uuid"] == s["u"]) & (pieces["a_us"] >= s["from_us"]) & (pieces["a_us"] < s["until"]), "left").select(
        "account_uuid", F.col("a_us").alias("from_us"), "to_us", "seat_tier", "user_tier", "org_tier"
    )


def month_shares(spans: DataFrame) -> DataFrame:
    """One row a calendar month that a span touches, with the part of the month it covers (UTC)."""
    first, last = F.timestamp_micros("from_us"), F.timestamp_micros(F.col("to_us") - 1)
    x = spans.withColumn("month", F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))))
    m0, m1 = F.unix_micros(F.col("month").cast("timestamp")), F.unix_micros(F.add_months("month", 1).cast("timestamp"))
    return x.withColumn("share", interval_overlap(F.col("from_us"), F.col("to_us"), m0, m1) / (m1 - m0))


def stretch_prices(pieces: DataFrame, prices: DataFrame) -> DataFrame:
    """``usd``: the seat's price at the stretch's start, else the plan's."""
    later = F.lead("from_us").over(Window.partitionBy("kind", "name").orderBy("from_us"))
    p = prices.withColumn("until", F.coalesce(later, F.lit(FOREVER)))
    out = pieces.withColumn("tier", F.coalesce("user_tier", "org_tier"))
    for kind, key, name in (("seats", "seat_tier", "seat_usd"), ("plans", "tier", "plan_usd")):
        d = small(p.where(F.col("kind") == kind).select(F.col("name").alias("__n"), F.col("from_us").alias("__f"), "until", F.col("usd").alias(name)))
        out = out.join(d, (F.col(key) == F.col("__n")) & (F.col("from_us") >= F.col("__f")) & (F.col("from_us") < F.col("until")), "left").drop("__n", "__f", "until")
    return out.withColumn("usd", F.coalesce("seat_usd", "plan_usd"))


def prorated(tiers: DataFrame, prices: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """(account_uuid, month, usd): null where nothing in the month was priced."""
    months = month_shares(stretch_prices(stretches(tiers, start_us, end_us), prices))
    return months.groupBy("account_uuid", F.date_format("month", "yyyy-MM").alias("month")).agg(F.sum(F.col("usd").cast("double") * F.col("share")).alias("usd"))
