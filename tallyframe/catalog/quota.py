"""Rate-limit windows, their spend and verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import NOW
from ..functions.money import ratio, usd
from ..functions.names import model_family
from ..operators import quota
from ..operators.asof import small
from ..registry import query
from .report_queries import FAMILY

N = f"({NOW} / 1000000.0)"


def inst(keys: str = "account_uuid") -> str:
    k = f"{keys}, " if keys else ""
    return f"""inst AS (SELECT *, peak - opening AS rise, round((peak_us - first_us) / 1000000.0, 6) AS fill_s, round_even(peak, 0) >= 100 AS hit,
  CASE WHEN peak > opening AND peak_us > first_us THEN round((peak - opening) / ((peak_us / 1000000.0) - (first_us / 1000000.0)) * 3600, 6) END AS pp_per_hour,
  round(greatest(first_us / 1000000.0 - (reset_min - span_s), 0.0), 6) AS unseen_s, opening >= 5 AS partial, reset_min > {N} AS open
 FROM (SELECT {k}s.win, model, CAST(round_even(resets_at / 60, 0) * 60 AS BIGINT) AS reset_min, max(used_pct) AS peak, min(ts_us) AS first_us, max(ts_us) AS last_us,
   arg_min(ts_us, (-used_pct, ts_us)) AS peak_us, arg_min(used_pct, (ts_us, event_id)) AS opening, arg_max(used_pct, (ts_us, event_id)) AS latest, count(*) AS n_samples,
   any_value(w.span_s) AS span_s, any_value(w.ord) AS ord, any_value(w.family) AS family
  FROM samples s JOIN window_spans w ON s.win = w.win WHERE NOT resets_at - ts_us / 1000000.0 > 8 * 86400 GROUP BY {k}s.win, model, reset_min))"""


def _inst(t, *keys):
    return quota.window_instances(t.samples, t.window_spans, NOW, keys)


@query(f"WITH {inst('')} SELECT win, model, reset_min, n_samples FROM inst")
def quota_instances(t):
    return _inst(t).select("win", "model", "reset_min", "n_samples")


@query("""WITH g AS (SELECT account_uuid, win, model, CAST(round_even(resets_at / 60, 0) * 60 AS BIGINT) AS reset_min, machine_id, min(ts_us) AS m, count(*) AS n FROM samples
 WHERE NOT resets_at - ts_us / 1000000.0 > 8 * 86400 GROUP BY ALL)
SELECT account_uuid, win, model, reset_min, CAST(sum(n) AS BIGINT) AS n_samples, string_agg(machine_id, ',' ORDER BY m, machine_id) AS machines FROM g GROUP BY 1, 2, 3, 4""")
def quota_instances_merged(t):
    keys = ("account_uuid", "win", "model", "reset_min")
    each = t.samples.where(~quota.is_placeholder()).withColumn("reset_min", quota.reset_minute()).groupBy(*keys, "machine_id").agg(F.min("ts_us").alias("m"), F.count(F.lit(1)).alias("n"))
    heard = F.transform(F.sort_array(F.collect_list(F.struct("m", "machine_id"))), lambda x: x["machine_id"])
    return each.groupBy(*keys).agg(F.sum("n").alias("n_samples"), F.concat_ws(",", heard).alias("machines"))


_MEASURES = ("peak", "first_us", "last_us", "peak_us", "opening", "latest", "rise", "fill_s", "hit", "pp_per_hour", "unseen_s", "partial", "open", "n_samples")


@query(f"WITH {inst()} SELECT account_uuid, win, model, reset_min, {', '.join(_MEASURES)} FROM inst")
def quota_instance_measures(t):
    return _inst(t, "account_uuid").select("account_uuid", "win", "model", "reset_min", *_MEASURES)


@query(f"""WITH {inst()} SELECT account_uuid, win, model, reset_min, CASE WHEN last_us / 1000000.0 - (reset_min - span_s) > 0
 THEN round(latest / (last_us / 1000000.0 - (reset_min - span_s)) * span_s, 6) END AS projected FROM inst""")
def quota_projection(t):
    return quota.projection(_inst(t, "account_uuid")).select("account_uuid", "win", "model", "reset_min", "projected")


# by the rule: a window that never rose has no price; one that rose without calls cost 0
_SPEND = f"""{inst()}, fam AS (SELECT *, {FAMILY} AS f FROM calls),
iw AS (SELECT * REPLACE (CASE WHEN model IS NOT NULL THEN {FAMILY} ELSE family END AS family) FROM inst),
sp AS (SELECT i.account_uuid, i.win, i.model, i.reset_min, any_value(i.rise) AS rise, any_value(i.peak) AS peak, any_value(i.hit) AS hit, any_value(i.open) AS open, any_value(i.latest) AS latest,
 CASE WHEN any_value(i.rise) > 0 THEN coalesce(sum(cost), 0) END AS spend, CASE WHEN any_value(i.rise) > 0 THEN coalesce(sum(cache_read), 0) END AS cache_read,
 CASE WHEN any_value(i.rise) > 0 THEN coalesce(sum(input_tokens + cache_create + cache_read), 0) END AS observed, CASE WHEN any_value(i.rise) > 0 THEN count(c.rid) END AS n_calls
 FROM iw i LEFT JOIN fam c ON i.rise > 0 AND c.account_uuid = i.account_uuid AND c.ts_us BETWEEN i.first_us AND i.peak_us AND (i.family IS NULL OR i.family = c.f) GROUP BY 1, 2, 3, 4)"""
_KEYS = ("account_uuid", "win", "model", "reset_min")


def _priced(t):
    i = _inst(t, "account_uuid").withColumn("family", quota.window_family(model_family(F.col("model"))))
    calls = t.calls.select("account_uuid", "ts_us", model_family(F.col("model")).alias("family"), "cost", "cache_read", (F.col("input_tokens") + F.col("cache_create") + F.col("cache_read")).alias("observed"))
    return quota.priced_instances(i, calls)


@query(f"""WITH {_SPEND} SELECT account_uuid, win, model, reset_min, round(CAST(spend AS DOUBLE), 6) AS spend, CAST(cache_read AS BIGINT) AS cache_read, CAST(observed AS BIGINT) AS observed, n_calls FROM sp""")
def span_window_spend(t):
    return _priced(t).select(*_KEYS, usd(F.col("spend")).alias("spend"), "cache_read", "observed", "n_calls")


@query(f"WITH {inst()} SELECT account_uuid, win, model, reset_min, CAST(row_number() OVER (ORDER BY ord, reset_min DESC, coalesce(model, ''), account_uuid) AS INTEGER) AS place FROM inst")
def sort_window_rows(t):
    """Known window types first, newest reset first: numbered within a type, after the counts of the types before."""
    x = _inst(t, "account_uuid").select("account_uuid", "win", "model", "reset_min", "ord", F.floor(F.col("reset_min") / 2_592_000).alias("month"))
    # a type and a month of resets at a time, so that no task takes all
    counts = x.groupBy("ord", "month").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("ord", "month", F.coalesce(F.sum("n").over(Window.orderBy("ord", F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("ord", "month").orderBy(F.desc("reset_min"), F.coalesce("model", F.lit("")), "account_uuid")
    placed = x.withColumn("at", F.row_number().over(w)).join(starts, ["ord", "month"])
    return placed.select("account_uuid", "win", "model", "reset_min", (F.col("before") + F.col("at")).cast("int").alias("place"))


@query("SELECT account_uuid, win, arg_max(used_pct, (ts_us, event_id)) AS used_pct, arg_max(resets_at, (ts_us, event_id)) AS resets_at, max(ts_us) AS ts_us FROM samples GROUP BY 1, 2")
def latest_per_window(t):
    return quota.latest_readings(t.samples, ("account_uuid", "win")).drop("source")


@query(f"WITH {inst()} SELECT i.account_uuid, win, model, reset_min, tier FROM inst i JOIN (SELECT account_uuid, arg_max(coalesce(user_tier, org_tier), from_us) AS tier FROM account_tiers WHERE from_us <= {NOW} GROUP BY 1) t ON t.account_uuid = i.account_uuid WHERE tier IS NOT NULL")
def filter_tiered_windows(t):
    tiers = t.account_tiers.where(F.col("from_us") <= NOW).groupBy("account_uuid").agg(F.max_by(F.coalesce("user_tier", "org_tier"), "from_us").alias("tier"))
    return _inst(t, "account_uuid").select(*_KEYS).join(small(tiers.where("tier IS NOT NULL")), "account_uuid")


# from the rule: number the readings of a series, find the baseline and the last one inside, add up what lies between
_EXTRA = inst() + f""", win AS (SELECT account_uuid, win, model, reset_min, CAST((reset_min - span_s) * 1000000 AS BIGINT) AS a, CAST(least(reset_min * 1000000, {NOW}) AS BIGINT) AS z FROM inst),
series AS (SELECT account_uuid, machine_id, ts_us, spent_cents, row_number() OVER (PARTITION BY account_uuid, machine_id ORDER BY ts_us, event_id) AS i FROM extra),
cand AS (SELECT w.*, s.machine_id, max(i) FILTER (ts_us <= a) AS base0, max(i) FILTER (ts_us <= z) AS final, min(i) FILTER (ts_us >= a) AS opening, count(*) FILTER (ts_us BETWEEN a AND z) AS n_inside
 FROM win w JOIN series s USING (account_uuid) GROUP BY ALL),
based AS (SELECT c.*, CASE WHEN base0 IS NOT NULL THEN base0 WHEN opening <= final AND o.spent_cents = 0 THEN opening END AS base FROM cand c LEFT JOIN series o ON o.account_uuid = c.account_uuid AND o.machine_id = c.machine_id AND o.i = c.opening),
added AS (SELECT b.account_uuid, b.win, b.model, b.reset_min, b.machine_id, b.n_inside, CAST(sum(CASE WHEN n.spent_cents >= p.spent_cents THEN n.spent_cents - p.spent_cents ELSE n.spent_cents END) AS BIGINT) AS added
 FROM based b LEFT JOIN series n ON n.account_uuid = b.account_uuid AND n.machine_id = b.machine_id AND n.i > b.base AND n.i <= b.final
 LEFT JOIN series p ON p.account_uuid = n.account_uuid AND p.machine_id = n.machine_id AND p.i = n.i - 1 WHERE b.n_inside > 0 GROUP BY ALL)"""


@query(f"""WITH {_EXTRA} SELECT w.account_uuid, w.win, w.model, w.reset_min, machine_id, added, coalesce(n_inside, 0) AS n_inside FROM win w
 LEFT JOIN added x ON x.account_uuid = w.account_uuid AND x.win = w.win AND x.model IS NOT DISTINCT FROM w.model AND x.reset_min = w.reset_min""")
def span_extra_spend(t):
    """Cents added while each window ran, per machine's series; null where no reading bounds it."""
    return quota.extra_spans(_inst(t, "account_uuid"), t.extra, NOW)


@query(f"""WITH {_EXTRA}, best AS (SELECT * FROM added WHERE added IS NOT NULL QUALIFY row_number() OVER (PARTITION BY account_uuid, win, model, reset_min ORDER BY n_inside DESC, machine_id) = 1)
SELECT w.account_uuid, w.win, w.model, w.reset_min, machine_id, added FROM win w LEFT JOIN best x ON x.account_uuid = w.account_uuid AND x.win = w.win AND x.model IS NOT DISTINCT FROM w.model AND x.reset_min = w.reset_min""")
def span_extra_best_machine(t):
    """What the machine that watched the window most closely says."""
    return quota.closest_series(quota.extra_spans(_inst(t, "account_uuid"), t.extra, NOW), list(_KEYS))


_BEST = """best AS (SELECT * FROM added WHERE added IS NOT NULL QUALIFY row_number() OVER (PARTITION BY account_uuid, win, model, reset_min ORDER BY n_inside DESC, machine_id) = 1),
j AS (SELECT sp.*, added FROM sp LEFT JOIN best b ON sp.account_uuid = b.account_uuid AND sp.win = b.win AND sp.model IS NOT DISTINCT FROM b.model AND sp.reset_min = b.reset_min)"""


def _with_extra(t):
    """Priced instances and what each billed on top, which doesn't depend on a rise."""
    x = _priced(t)
    best = quota.closest_series(quota.extra_spans(_inst(t, "account_uuid"), t.extra, NOW), list(_KEYS))
    return x.join(best.select(*[F.col(k).alias(f"__{k}") for k in _KEYS], "added"), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in _KEYS], "left").drop(*[f"__{k}" for k in _KEYS])


@query(f"""WITH {_SPEND}, {_EXTRA.removeprefix(inst() + ", ")}, {_BEST}
SELECT win, count(*) AS n, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS hits, max(peak) AS max_peak, round(CAST(sum(spend) AS DOUBLE), 6) AS spend,
 round(CAST(sum(spend) FILTER (rise > 0) AS DOUBLE) / nullif(sum(rise) FILTER (rise > 0), 0), 6) AS usd_per_pp,
 round(CAST(sum(cache_read) AS DOUBLE) / nullif(CAST(sum(observed) AS DOUBLE), 0), 6) AS cache_hit, CAST(sum(added) AS BIGINT) AS extra_cents FROM j GROUP BY win""")
def quota_group_summary(t):
    """A window type's footer: the money of those that rose, and the Extra of all."""
    return quota.group_summary(_with_extra(t)).withColumn("spend", usd(F.col("spend")))


@query(f"""WITH {_SPEND}, {_EXTRA.removeprefix(inst() + ", ")}, {_BEST}
SELECT account_uuid, win, model, reset_min, peak, hit, open, round(CAST(spend AS DOUBLE), 6) AS spend, round(CAST(spend AS DOUBLE) / rise, 6) AS usd_per_pp,
 CASE WHEN open THEN round(CAST(spend AS DOUBLE) / rise * greatest(100 - latest, 0), 6) END AS headroom, added AS extra_cents FROM j""")
def sink_limits_export(t):
    """One row per instance with raw numbers; headroom only while the window is open, and never below 0."""
    return _with_extra(t).select(*_KEYS, "peak", "hit", "open", usd(F.col("spend")).alias("spend"), F.round("per_pp", 6).alias("usd_per_pp"), F.round("headroom", 6).alias("headroom"), F.col("added").alias("extra_cents"))


_START = NOW - 7 * 86_400_000_000


@query(f"""SELECT account_uuid, machine_id, arg_max(spent_cents, (ts_us, event_id)) AS now_cents,
 CASE WHEN count(*) FILTER (ts_us <= {_START}) > 0 THEN greatest(arg_max(spent_cents, (ts_us, event_id)) - arg_max(spent_cents, (ts_us, event_id)) FILTER (ts_us <= {_START}), 0) END AS delta_cents
FROM extra WHERE ts_us <= {NOW} GROUP BY 1, 2""")
def asof_extra_deltas(t):
    """Now less the last reading before the week, floored at 0; null without one."""
    x = t.extra.where(F.col("ts_us") <= NOW)
    order = F.struct("ts_us", "event_id")
    old = F.max_by("spent_cents", F.when(F.col("ts_us") <= _START, order))
    return x.groupBy("account_uuid", "machine_id").agg(F.max_by("spent_cents", order).alias("now_cents"), old.alias("old")).select(
        "account_uuid", "machine_id", "now_cents", F.when(F.col("old").isNotNull(), F.greatest(F.col("now_cents") - F.col("old"), F.lit(0))).alias("delta_cents"))


@query(f"""WITH l AS (SELECT account_uuid, arg_max(used_pct, (ts_us, event_id)) AS used, arg_max(resets_at, (ts_us, event_id)) AS r FROM samples WHERE win = 'week' AND ts_us <= {NOW} AND NOT resets_at - ts_us / 1000000.0 > 8 * 86400 GROUP BY 1)
SELECT account_uuid, used, CASE WHEN r > {N} THEN round(({N} - (r - 604800)) / 604800 * 100, 6) END AS expected, CASE WHEN r > {N} THEN round(used - ({N} - (r - 604800)) / 604800 * 100, 6) END AS ahead FROM l""")
def quota_weekly_pace(t):
    week = t.samples.where((F.col("win") == "week") & (F.col("ts_us") <= NOW) & ~quota.is_placeholder())
    x = quota.latest_readings(week, ("account_uuid",))
    gone = (F.lit(NOW / 1e6) - (F.col("resets_at") - 604800)) / 604800 * 100
    live = F.col("resets_at") > NOW / 1e6
    return x.select("account_uuid", F.col("used_pct").alias("used"), F.when(live, F.round(gone, 6)).alias("expected"), F.when(live, F.round(F.col("used_pct") - gone, 6)).alias("ahead"))


#: Percents from which to warn and to stop.
WARN, STOP = 80, 95
GUARDED = "(SELECT account_uuid, max(ts_us) AS now_us FROM samples WHERE ts_us <= {now} AND account_uuid <> 'acct-3' GROUP BY 1 UNION ALL SELECT 'acct-9', CAST({now} AS BIGINT))"


ORACLE_VERDICT = f"""WITH g AS {GUARDED.format(now=NOW)}, f AS (SELECT s.account_uuid, s.win, s.source, any_value(now_us) AS now_us, arg_max((used_pct, resets_at, ts_us), (ts_us, event_id)) AS r FROM samples s JOIN g USING (account_uuid) WHERE ts_us <= now_us GROUP BY 1, 2, 3),
seen AS (SELECT account_uuid, win, max(CASE WHEN r[2] <= now_us / 1000000.0 THEN 0 ELSE r[1] END) FILTER (now_us - r[3] <= CASE source WHEN 'stdin' THEN 900 ELSE 3600 END * CAST(1000000 AS BIGINT)) AS pct FROM f GROUP BY 1, 2),
st AS (SELECT g.account_uuid, w.win, s.pct, s.win IS NOT NULL AS has, p.applicable AS app FROM g CROSS JOIN window_spans w LEFT JOIN seen s ON s.account_uuid = g.account_uuid AND s.win = w.win LEFT JOIN plan_windows p ON p.account_uuid = g.account_uuid AND p.win = w.win),
shown AS (SELECT * FROM st WHERE pct IS NOT NULL OR app IS NOT FALSE AND (has OR app))
SELECT g.account_uuid, max(pct) AS pct, CASE WHEN count(s.win) = 0 OR max(pct) >= {STOP} THEN 'stop' WHEN count(*) FILTER (s.win IS NOT NULL AND pct IS NULL) > 0 THEN 'unknown' WHEN max(pct) >= {WARN} THEN 'warn' ELSE 'ok' END AS verdict
FROM g LEFT JOIN shown s ON s.account_uuid = g.account_uuid GROUP BY 1"""


@query(ORACLE_VERDICT)
def quota_verdict(t):
    """Of each account at its own newest reading; one account has none at all."""
    read = t.samples.where((F.col("ts_us") <= NOW) & (F.col("account_uuid") != "acct-3")).groupBy("account_uuid").agg(F.max("ts_us").alias("now_us"))
    accounts = read.unionByName(t.spark.createDataFrame([("acct-9", NOW)], "account_uuid string, now_us long"))
    return quota.verdicts(t.samples, accounts, t.plan_windows, ["session", "week", "sonnet", "scoped"], WARN, STOP)


ORACLE_WARN = f"SELECT account_uuid, win, model, CAST(round_even(resets_at / 60, 0) * 60 AS BIGINT) AS reset_min, min(ts_us) AS first_warned_us FROM samples WHERE used_pct >= {WARN} AND NOT resets_at - ts_us / 1000000.0 > 8 * 86400 GROUP BY 1, 2, 3, 4"


@query(ORACLE_WARN)
def quota_warn_once(t):
    warned = t.samples.where((F.col("used_pct") >= WARN) & ~quota.is_placeholder()).withColumn("reset_min", quota.reset_minute())
    return warned.groupBy("account_uuid", "win", "model", "reset_min").agg(F.min("ts_us").alias("first_warned_us"))


@query(f"""WITH {_SPEND} SELECT account_uuid, win, model, CAST(reset_min AS BIGINT) AS reset_min, round(CAST(cache_read AS DOUBLE) / nullif(CAST(observed AS DOUBLE), 0), 6) AS cache_hit FROM sp""", name="quota_instance_cache_hit")
def quota_instance_cache_hit(t):
    """Null without a rise and without input."""
    return _priced(t).select(*_KEYS, ratio(F.col("cache_read"), F.col("observed")).alias("cache_hit"))
