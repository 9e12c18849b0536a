"""Series on dense axes: days, hours, window buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import DAY, HOUR, NOW
from ..functions.money import KINDS, usd
from ..functions.names import short_model
from ..operators import quota
from ..operators.series import covered_axis, dense_days, fill_curve, on_axis
from ..registry import query
from .report_queries import SHORT, _u

FIRST, LAST = "2024-01-01", "2024-01-31"
DAYS = f"days AS (SELECT strftime(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)), '%Y-%m-%d') AS day)"


@query(f"""WITH {DAYS}, a AS (SELECT DISTINCT account_uuid FROM calls), v AS (SELECT day, account_uuid, sum(cost) AS c, sum(tokens) AS tk FROM calls GROUP BY ALL)
SELECT day, account_uuid, {_u('coalesce(c, 0)')} AS cost, CAST(coalesce(tk, 0) AS BIGINT) AS tokens FROM days CROSS JOIN a LEFT JOIN v USING (day, account_uuid)""")
def series_daily_by_account(t):
    v = t.calls.groupBy("day", "account_uuid").agg(F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"))
    x = on_axis(dense_days(t.spark, FIRST, LAST), v, "day", "account_uuid")
    return x.select("day", "account_uuid", usd(F.coalesce("cost", F.lit(0).cast("decimal(38,10)"))).alias("cost"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


@query("SELECT strftime(unnest(generate_series(min(CAST(day AS DATE)), max(CAST(day AS DATE)), INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM calls WHERE project = 'proj4'")
def series_covered_axis(t):
    return covered_axis(t.calls.where("project = 'proj4'"))


_MID = 1704931200000000  # 2024-01-11


@query(f"""WITH v AS (SELECT (ts_us - {_MID}) // {HOUR} AS hour, sum(cost) AS c, sum(n_calls) AS n FROM calls WHERE ts_us >= {_MID} AND ts_us < {_MID + DAY} GROUP BY 1)
SELECT CAST(h AS BIGINT) AS hour, {_u('coalesce(c, 0)')} AS cost, CAST(coalesce(n, 0) AS BIGINT) AS n_calls FROM range(24) r(h) LEFT JOIN v ON v.hour = h""")
def series_hourly(t):
    v = t.calls.where((F.col("ts_us") >= _MID) & (F.col("ts_us") < _MID + DAY)).groupBy(F.floor((F.col("ts_us") - _MID) / HOUR).cast("long").alias("hour")).agg(F.sum("cost").alias("c"), F.sum("n_calls").alias("n"))
    hours = t.spark.range(24).withColumnRenamed("id", "hour")
    return hours.join(F.broadcast(v), "hour", "left").select("hour", usd(F.coalesce("c", F.lit(0).cast("decimal(38,10)"))).alias("cost"), F.coalesce("n", F.lit(0)).alias("n_calls"))


@query("SELECT day, kind, CAST(sum(n) AS BIGINT) AS tokens FROM (" + " UNION ALL ".join(f"SELECT day, '{k}' AS kind, {k} AS n FROM calls" for k in KINDS) + ") GROUP BY ALL")
def series_tokens_by_kind(t):
    sums = t.calls.groupBy("day").agg(*[F.sum(k).alias(k) for k in KINDS])
    return sums.unpivot(["day"], list(KINDS), "kind", "tokens")


@query(f"SELECT strftime(make_timestamp({NOW}) - to_days(CAST(d - 1 AS INTEGER)), '%Y-%m-%d') AS first_day, '2024-01-26' AS end_day, d AS days FROM (VALUES (7), (30)) v(d) UNION ALL SELECT strftime(make_timestamp(min(ts_us)), '%Y-%m-%d'), '2024-01-26', CAST(date_diff('day', CAST(make_timestamp(min(ts_us)) AS DATE), DATE '2024-01-26') AS INTEGER) FROM rec")
def series_range_bounds(t):
    """Whole days ending next midnight; all time runs from the oldest record."""
    today = F.to_date(F.timestamp_micros(F.lit(NOW)))
    oldest = F.to_date(F.timestamp_micros(F.min("ts_us")))
    rows = F.explode(F.array(*[F.struct(F.date_sub(today, n - 1).alias("a"), F.lit(n).alias("d")) for n in (7, 30)], F.struct(F.col("o").alias("a"), (F.datediff(today, F.col("o")) + 1).alias("d"))))
    x = t.rec.agg(oldest.alias("o")).select(rows.alias("r"))
    return x.select(F.date_format("r.a", "yyyy-MM-dd").alias("first_day"), F.date_format(F.date_add(today, 1), "yyyy-MM-dd").alias("end_day"), F.col("r.d").alias("days"))


@query("""WITH w AS (SELECT DISTINCT date_trunc('week', CAST(day AS DATE)) AS a FROM calls)
SELECT strftime(a, '%Y-%m-%d') AS week, strftime(unnest(generate_series(a, a + INTERVAL 6 DAY, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM w""")
def series_period_days(t):
    """The days of every week that has calls, counted in dates."""
    a = t.calls.select(F.to_date(F.date_trunc("week", F.to_date("day"))).alias("a")).distinct()
    return a.select(F.date_format("a", "yyyy-MM-dd").alias("week"), F.explode(F.sequence("a", F.date_add("a", 6))).alias("d")).select("week", F.date_format("d", "yyyy-MM-dd").alias("day"))


@query(f"""WITH c AS (SELECT *, {SHORT} AS short FROM calls WHERE project = 'proj4')
SELECT 'cost' AS chart, day, short AS trace, {_u('sum(cost)')} AS value FROM c GROUP BY ALL
UNION ALL SELECT 'calls', day, 'calls', CAST(sum(n_calls) AS DOUBLE) FROM c GROUP BY ALL
UNION ALL SELECT 'tokens', day, kind, CAST(sum(n) AS DOUBLE) FROM (""" + " UNION ALL ".join(f"SELECT day, '{k}' AS kind, {k} AS n FROM c" for k in KINDS) + ") GROUP BY ALL")
def series_entity_charts(t):
    """A project's charts; its cost chart has several traces and stays."""
    c = t.calls.where("project = 'proj4'").withColumn("short", short_model(F.col("model")))
    cost = c.groupBy("day", F.col("short").alias("trace")).agg(usd(F.sum("cost")).alias("value")).withColumn("chart", F.lit("cost"))
    several = cost.agg((F.count_distinct("trace") > 1).alias("several"))
    cost = cost.join(F.broadcast(several), F.col("several")).drop("several")
    calls = c.groupBy("day").agg(F.sum("n_calls").cast("double").alias("value")).select("day", F.lit("calls").alias("trace"), "value", F.lit("calls").alias("chart"))
    kinds = c.groupBy("day").agg(*[F.sum(k).alias(k) for k in KINDS]).unpivot(["day"], list(KINDS), "trace", "value").select("day", "trace", F.col("value").cast("double").alias("value"), F.lit("tokens").alias("chart"))
    return cost.unionByName(calls).unionByName(kinds)


_WK = 1705536000  # a weekly window's reset: its instance covers the seven days before
_W0 = (_WK - 604800) * 1_000_000


@query(f"""WITH s AS (SELECT machine_id, (ts_us - {_W0}) // {6 * HOUR} AS bucket, arg_max(used_pct, (ts_us, event_id)) AS pct FROM samples WHERE win = 'week' AND account_uuid = 'acct-0' AND CAST(round_even(resets_at / 60, 0) * 60 AS BIGINT) = {_WK} GROUP BY 1, 2),
x AS (SELECT machine_id, b FROM (SELECT DISTINCT machine_id FROM s) CROSS JOIN range(28) r(b)) SELECT x.machine_id, CAST(b AS BIGINT) AS bucket, pct FROM x LEFT JOIN s ON s.machine_id = x.machine_id AND s.bucket = b""")
def series_fill_curve(t):
    """The last reading in each six hours of one weekly window, null where nothing was measured."""
    own = t.samples.where("win = 'week' AND account_uuid = 'acct-0'").where(quota.reset_minute() == _WK)
    return fill_curve(own, _W0, 6 * HOUR, 28)


@query(f"SELECT (ts_us - {_W0}) // {HOUR} AS bucket, {SHORT} AS short, {_u('sum(cost)')} AS cost, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(n_calls) AS BIGINT) AS n_calls FROM calls WHERE account_uuid = 'acct-0' AND ts_us >= {_W0} AND ts_us < {_WK * 1_000_000} GROUP BY ALL")
def series_window_charts(t):
    """One window's calls on its axis: hours here, five minutes for spans up to six hours."""
    step = 300_000_000 if 604800 <= 6 * 3600 else HOUR
    c = t.calls.where((F.col("account_uuid") == "acct-0") & (F.col("ts_us") >= _W0) & (F.col("ts_us") < _WK * 1_000_000))
    return c.groupBy(F.floor((F.col("ts_us") - _W0) / step).cast("long").alias("bucket"), short_model(F.col("model")).alias("short")).agg(usd(F.sum("cost")).alias("cost"), F.sum("tokens").alias("tokens"), F.sum("n_calls").alias("n_calls"))
