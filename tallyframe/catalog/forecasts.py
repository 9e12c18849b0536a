"""Forecasts and plan value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import NOW
from ..operators.asof import small
from ..plans import forecast
from ..registry import query
from .report_queries import _fx

TODAY = "2024-01-25"
DAYS = f"day_cost AS (SELECT account_uuid, CAST(day AS DATE) AS d, CAST(sum(cost) AS DOUBLE) AS c FROM calls WHERE day <= '{TODAY}' GROUP BY ALL)"


def _mean(prefix: str = "") -> str:
    """An account's decayed mean over its active days; exp and ln as the rule states it."""
    w = f"exp(-greatest(DATE '{TODAY}' - {prefix}d, 0) * ln(2) / 7)"
    return f"CASE WHEN count(*) FILTER ({prefix}c > 0) >= 3 THEN sum({w} * {prefix}c) FILTER ({prefix}c > 0) / sum({w}) FILTER ({prefix}c > 0) END"


@query("SELECT account_uuid, day, round(CAST(sum(cost) AS DOUBLE), 6) AS cost FROM calls GROUP BY ALL")
def forecast_daily_costs(t):
    return forecast.daily_costs(t.calls).withColumn("cost", F.round(F.col("cost").cast("double"), 6))


@query(f"WITH {DAYS} SELECT account_uuid, count(*) FILTER (c > 0) AS active, round({_mean()}, 6) AS rate FROM day_cost GROUP BY 1")
def forecast_daily_rate(t):
    return forecast.daily_rate(forecast.daily_costs(t.calls, TODAY), TODAY).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {DAYS}, p AS (SELECT account_uuid, sum(c) AS spent, {_mean()} AS rate FROM day_cost WHERE d >= DATE '2024-01-01' AND d < DATE '2024-02-01' GROUP BY 1)
SELECT p.account_uuid, round(spent, 6) AS spent, round(spent + rate * (31 - 25), 6) AS forecast, CAST(25 AS INTEGER) AS elapsed, CAST(31 AS INTEGER) AS total, CAST(ceiling_usd AS DOUBLE) AS ceiling,
 round((spent + rate * (31 - 25)) / CAST(ceiling_usd AS DOUBLE), 6) AS share FROM p LEFT JOIN budgets b ON b.account_uuid = p.account_uuid WHERE rate IS NOT NULL""")
def forecast_calendar_month(t):
    now = F.to_date(F.lit(TODAY))
    x = forecast.period_forecast(forecast.daily_costs(t.calls, TODAY), F.trunc(now, "month"), F.add_months(F.trunc(now, "month"), 1), TODAY)
    b = t.budgets.select("account_uuid", F.col("ceiling_usd").cast("double").alias("ceiling"))
    share = F.round(F.try_divide("forecast", "ceiling"), 6)
    return x.join(small(b), "account_uuid", "left").select("account_uuid", F.round("spent", 6).alias("spent"), F.round("forecast", 6).alias("forecast"), "elapsed", "total", "ceiling", share.alias("share"))


@query(f"""WITH {DAYS}, bs AS (SELECT *, CASE WHEN renewal_day = 31 THEN DATE '2023-12-31' ELSE DATE '2024-01-15' END AS a, CASE WHEN renewal_day = 31 THEN DATE '2024-01-31' ELSE DATE '2024-02-15' END AS z FROM budgets),
p AS (SELECT x.account_uuid, any_value(a) AS a, any_value(z) AS z, sum(c) AS spent, {_mean('x.')} AS rate FROM day_cost x JOIN bs USING (account_uuid) WHERE d >= a AND d < z GROUP BY 1)
SELECT account_uuid, strftime(a, '%Y-%m-%d') AS starts, round(spent, 6) AS spent, round(spent + rate * greatest((z - a) - (DATE '{TODAY}' - a + 1), 0), 6) AS forecast FROM p WHERE rate IS NOT NULL""")
def forecast_billing_month(t):
    start = forecast.billing_start(F.to_date(F.lit(TODAY)), F.col("renewal_day"))
    b = small(t.budgets.withColumn("starts", start).withColumn("ends", forecast.billing_end(F.col("starts"), F.col("renewal_day"))))
    x = forecast.period_forecast(forecast.daily_costs(t.calls, TODAY).join(b, "account_uuid"), F.col("starts"), F.col("ends"), TODAY)
    return x.join(b.select("account_uuid", F.date_format("starts", "yyyy-MM-dd").alias("starts")), "account_uuid").select("account_uuid", "starts", F.round("spent", 6).alias("spent"), F.round("forecast", 6).alias("forecast"))


_W0, _W1 = NOW - 4 * 86_400_000_000, NOW + 3 * 86_400_000_000


@query(f"SELECT account_uuid, round(CAST(sum(cost) AS DOUBLE), 6) AS cost, CASE WHEN sum(cost) > 0 THEN round(CAST(sum(cost) AS DOUBLE) / (4.0 / 7.0), 6) END AS at_reset FROM calls WHERE ts_us >= {_W0} AND ts_us <= {NOW} GROUP BY 1")
def forecast_window(t):
    """Cost of a running week to its reset; null under 5 % elapsed, past the reset, or without cost."""
    gone = (NOW - _W0) / (_W1 - _W0)
    x = t.calls.where((F.col("ts_us") >= _W0) & (F.col("ts_us") <= NOW)).groupBy("account_uuid").agg(F.sum("cost").cast("double").alias("c"))
    known = (F.lit(gone) >= 0.05) & F.lit(NOW < _W1) & (F.col("c") > 0)
    return x.select("account_uuid", F.round("c", 6).alias("cost"), F.when(known, F.round(F.col("c") / gone, 6)).alias("at_reset"))


@query(f"""WITH x AS (SELECT CAST(day AS DATE) AS d, cost FROM calls WHERE day <= '{TODAY}'), s AS (SELECT max(d) AS newest, CAST(sum(cost) FILTER (d >= DATE '2024-01-01') AS DOUBLE) AS m,
 CAST(sum(cost) FILTER (d BETWEEN DATE '2024-01-11' AND DATE '2024-01-24') AS DOUBLE) AS f FROM x)
SELECT round(m, 6) AS spent, round(m / 25 * 31, 6) AS by_month, CASE WHEN f > 0 THEN round(f / 14 * 31, 6) END AS by_fortnight FROM s WHERE newest >= DATE '2024-01-01'""")
def forecast_month_projection(t):
    x = forecast.month_projection(t.calls.where(F.col("day") <= TODAY), TODAY)
    return x.select(*[F.round(c, 6).alias(c) for c in x.columns])


S0, S1 = 1704067200000000, 1706745600000000  # January 2024
_STRETCH = f"""edges AS (SELECT account_uuid, from_us AS a FROM account_tiers WHERE from_us > {S0} AND from_us < {S1} UNION SELECT account_uuid, {S0} FROM account_tiers),
pieces AS (SELECT account_uuid, a AS from_us, coalesce(lead(a) OVER (PARTITION BY account_uuid ORDER BY a), {S1}) AS to_us FROM edges),
tv AS (SELECT *, coalesce(lead(from_us) OVER (PARTITION BY account_uuid ORDER BY from_us), 9223372036854775807) AS until FROM account_tiers),
st AS (SELECT p.account_uuid, p.from_us, p.to_us, seat_tier, user_tier, org_tier FROM pieces p LEFT JOIN tv ON tv.account_uuid = p.account_uuid AND p.from_us >= tv.from_us AND p.from_us < tv.until),
pv AS (SELECT *, coalesce(lead(from_us) OVER (PARTITION BY kind, name ORDER BY from_us), 9223372036854775807) AS until FROM plan_prices),
priced AS (SELECT st.*, coalesce(s.usd, p.usd) AS usd FROM st LEFT JOIN pv s ON s.kind = 'seats' AND s.name = seat_tier AND st.from_us >= s.from_us AND st.from_us < s.until
 LEFT JOIN pv p ON p.kind = 'plans' AND p.name = coalesce(user_tier, org_tier) AND st.from_us >= p.from_us AND st.from_us < p.until)"""


@query(f"WITH {_STRETCH} SELECT * FROM st")
def plan_stretches(t):
    return forecast.stretches(t.account_tiers, S0, S1)


@query(f"WITH {_STRETCH} SELECT account_uuid, '2024-01' AS month, round(sum(CAST(usd AS DOUBLE) * (to_us - from_us) / ({S1} - {S0})), 6) AS usd FROM priced GROUP BY 1")
def plan_prorated_cost(t):
    return forecast.prorated(t.account_tiers, t.plan_prices, S0, S1).withColumn("usd", F.round("usd", 6))


@query("""WITH s AS (SELECT sid, min(ts_us) AS a, max(ts_us) + 86400000000 * 40 AS z FROM rec WHERE ts_us >= 1705708800000000 GROUP BY 1)
SELECT sid, round((1706745600000000 - a) / 2678400000000.0 + (least(z, 1709251200000000) - 1706745600000000) / 2505600000000.0 + greatest(z - 1709251200000000, 0) / 2678400000000.0, 6) AS months FROM s""")
def plan_months_in_span(t):
    """Calendar months, in parts, from a session's first call to forty days after its last: January's part, February, March's part."""
    spans = t.rec.where(F.col("ts_us") >= 1705708800000000).groupBy("sid").agg(F.min("ts_us").alias("from_us"), (F.max("ts_us") + F.lit(86_400_000_000 * 40)).alias("to_us"))
    return forecast.month_shares(spans).groupBy("sid").agg(F.round(F.sum("share"), 6).alias("months"))


_VALUE = f"""{_STRETCH}, plan AS (SELECT account_uuid, sum(CAST(usd AS DOUBLE) * (to_us - from_us) / ({S1} - {S0})) AS usd FROM priced GROUP BY 1),
use AS (SELECT account_uuid, CAST(sum(cost) AS DOUBLE) AS cost FROM calls WHERE substr(day, 1, 7) = '2024-01' GROUP BY 1)"""


@query(f"""WITH {_VALUE} SELECT use.account_uuid, '2024-01' AS month, round(cost, 6) AS cost, round(usd, 6) AS plan_usd, round(cost / nullif(usd, 0), 6) AS multiple, round(cost - usd, 6) AS saved,
 round((cost - usd) * CAST((SELECT rate FROM fx_rates WHERE rate > 0 AND date >= '2024-01-21' ORDER BY date DESC LIMIT 1) AS DOUBLE), 4) AS saved_nok FROM use LEFT JOIN plan USING (account_uuid)""")
def plan_value_by_month(t):
    """Use against plan per month; the saving in NOK at the rate of the month's last day."""
    plan = forecast.prorated(t.account_tiers, t.plan_prices, S0, S1)
    use = t.calls.groupBy("account_uuid", F.substring("day", 1, 7).alias("month")).agg(F.sum("cost").cast("double").alias("cost")).where("month = '2024-01'")
    fx = _fx(t).select(F.col("date").alias("last"), F.col("rate").cast("double").alias("rate"))
    x = use.join(plan, ["account_uuid", "month"], "left").withColumn("last", F.date_format(F.last_day(F.to_date(F.concat("month", F.lit("-01")))), "yyyy-MM-dd"))
    x = x.join(F.broadcast(fx), "last", "left")
    saved = F.col("cost") - F.col("usd")
    return x.select("account_uuid", "month", F.round("cost", 6).alias("cost"), F.round("usd", 6).alias("plan_usd"), F.round(F.try_divide("cost", "usd"), 6).alias("multiple"), F.round(saved, 6).alias("saved"), F.round(saved * F.col("rate"), 4).alias("saved_nok"))


@query(f"""WITH {_STRETCH}, span AS (SELECT account_uuid, min(ts_us) AS a, max(ts_us) AS z FROM calls WHERE machine_id = 'm1' GROUP BY 1),
m AS (SELECT p.account_uuid, sum(CAST(usd AS DOUBLE) * greatest(least(to_us, z) - greatest(from_us, a), 0) / ({S1} - {S0})) AS plan_usd FROM priced p JOIN span USING (account_uuid) GROUP BY 1)
SELECT account_uuid, round(plan_usd, 6) AS plan_usd FROM m""")
def plan_value_scope(t):
    """The plan's cost over the span that a scope's records cover, here a machine's."""
    span = t.calls.where("machine_id = 'm1'").groupBy("account_uuid").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("z"))
    pieces = forecast.stretch_prices(forecast.stretches(t.account_tiers, S0, S1), t.plan_prices).join(span, "account_uuid")
    cut = pieces.withColumns({"from_us": F.greatest("from_us", "a"), "to_us": F.least("to_us", "z")})
    empty = F.col("to_us") <= F.col("from_us")
    shares = forecast.month_shares(cut.where(~empty)).select("account_uuid", (F.col("usd").cast("double") * F.col("share")).alias("v"))
    none = cut.where(empty).select("account_uuid", F.when(F.col("usd").isNotNull(), F.lit(0.0)).alias("v"))
    return shares.unionByName(none).groupBy("account_uuid").agg(F.round(F.sum("v"), 6).alias("plan_usd"))
