"""Cost reports by day, month, project, session, account, machine and model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import DAY, HOUR, NOW
from ..functions.money import KINDS, converted, ratio, usd
from ..functions.names import model_family, short_model
from ..operators import reports
from ..operators.asof import small
from ..operators.attribution import apply_rules
from ..registry import query

SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (*KINDS, "tokens")) + ", round(CAST(sum(cost) AS DOUBLE), 6) AS cost, CAST(sum(n_calls) AS BIGINT) AS n_calls"
SHORT = "regexp_replace(regexp_replace(model, '^claude-', ''), '-[0-9]{8}$', '')"
FAMILY = "CASE WHEN contains(lower(model), 'haiku') THEN 'haiku' WHEN contains(lower(model), 'sonnet') THEN 'sonnet' WHEN contains(lower(model), 'opus') THEN 'opus' WHEN contains(lower(model), 'fable') THEN 'fable' ELSE 'other' END"


def _u(x):
    return f"round(CAST({x} AS DOUBLE), 6)"


@query(f"SELECT day, {SUMS} FROM calls GROUP BY day")
def report_daily(t):
    return reports.shown(reports.bucket(t.calls, "day"), "day")


@query(f"SELECT day, {SUMS} FROM calls GROUP BY day")
def report_daily_recomputed(t):
    """The same without stored verdicts: dedup and pricing at read."""
    return reports.shown(reports.bucket(t.recomputed_calls, "day"), "day")


@query(f"""WITH m AS (SELECT project, model, sum(cost) AS c, sum(tokens) AS tk, sum(n_calls) AS n FROM calls WHERE project IS NOT NULL GROUP BY ALL)
SELECT project, CAST(sum(tk) AS BIGINT) AS tokens, {_u('sum(c)')} AS cost, CAST(sum(n) AS BIGINT) AS n_calls,
  string_agg(CASE WHEN model <> '<synthetic>' THEN model || '=' || CAST(CAST(round(CAST(c AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR) END, ';' ORDER BY model) AS models FROM m GROUP BY project""")
def agg_bucket(t):
    """The bucket with its models; the map is spelled out, as maps have no order to compare."""
    b = reports.with_models(t.calls.where("project IS NOT NULL"), "project")
    pairs = F.transform(F.array_sort(F.map_entries("models")), lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 10000).cast("long").cast("string")))
    return b.select("project", "tokens", usd(F.col("cost")).alias("cost"), "n_calls", F.concat_ws(";", pairs).alias("models"))


@query(f"""WITH m AS (SELECT day, {SHORT} AS short, sum(cost) AS c, {SUMS} FROM calls GROUP BY ALL)
SELECT day, short, {', '.join(KINDS)}, tokens, cost, n_calls, CAST(row_number() OVER (PARTITION BY day ORDER BY c DESC, short) AS INTEGER) AS rank FROM m""")
def report_daily_breakdown(t):
    return reports.shown(reports.breakdown(t.calls, "day"), "day", "short", "rank")


@query(f"SELECT substr(day, 1, 7) AS month, {SUMS} FROM calls GROUP BY 1")
def report_monthly(t):
    return reports.shown(reports.bucket(t.calls, F.substring("day", 1, 7).alias("month")), "month")


def _ranked_sql(key, n, more=""):
    return f"""WITH r AS (SELECT {key}, sum(cost) AS c, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(n_calls) AS BIGINT) AS n_calls FROM calls {more} GROUP BY {key}),
top AS (SELECT * FROM r ORDER BY c DESC, {key} LIMIT {n})
SELECT {key}, {_u('c')} AS cost, tokens, n_calls, {_u('(SELECT sum(c) FROM top)')} AS shown_cost, {_u('(SELECT sum(c) FROM r)')} AS all_cost, (SELECT count(*) FROM r) AS n_all FROM top"""


def _ranked(calls, key, n):
    return reports.ranked(calls, key, n).select(key, usd(F.col("cost")).alias("cost"), "tokens", "n_calls", usd(F.col("shown_cost")).alias("shown_cost"), usd(F.col("all_cost")).alias("all_cost"), "n_all")


@query(_ranked_sql("project", 20, "WHERE project IS NOT NULL"))
def report_project(t):
    return _ranked(t.calls.where("project IS NOT NULL"), "project", 20)


@query(_ranked_sql("project", 5, "WHERE project IS NOT NULL"))
def topk_projects(t):
    return _ranked(t.calls.where("project IS NOT NULL"), "project", 5)


@query(_ranked_sql("sid", 20))
def topk_sessions(t):
    return _ranked(t.calls, "sid", 20)


@query(f"SELECT account_uuid, {SUMS} FROM calls GROUP BY account_uuid")
def report_account(t):
    return reports.shown(reports.bucket(t.calls, "account_uuid"), "account_uuid")


@query(f"SELECT sid, arg_min(coalesce(project, ''), (ts_us, rid)) AS project, max(ts_us) AS last_us, CAST(sum(tokens) AS BIGINT) AS tokens, {_u('sum(cost)')} AS cost, CAST(sum(n_calls) AS BIGINT) AS n_calls FROM calls GROUP BY sid")
def report_session(t):
    """The project of the earliest call, '' where it is hidden."""
    first = F.struct("ts_us", "rid")
    return t.calls.groupBy("sid").agg(
        F.min_by(F.coalesce("project", F.lit("")), first).alias("project"), F.max("ts_us").alias("last_us"), F.sum("tokens").alias("tokens"),
        usd(F.sum("cost")).alias("cost"), F.sum("n_calls").alias("n_calls"),
    )


@query(f"""WITH d AS (SELECT day, sum(cost) AS c, sum(tokens) AS tk, sum(n_calls) AS n FROM calls GROUP BY day)
SELECT count(*) AS n_rows, {_u('sum(c)')} AS cost, CAST(sum(tk) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) AS n_calls, round({_u('sum(c)')} / count(*), 6) AS average FROM d""")
def report_totals(t):
    x = reports.totals(reports.bucket(t.calls, "day"))
    return x.select("n_rows", usd(F.col("cost")).alias("cost"), "tokens", "n_calls", F.round(usd(F.col("cost")) / F.col("n_rows"), 6).alias("average"))


@query(f"SELECT day, machine_id, {_u('sum(cost)')} AS cost, CAST(sum(n_calls) AS BIGINT) AS n_calls FROM calls GROUP BY ALL")
def report_machine_split(t):
    x = reports.split_by(t.calls, "day", "machine_id")
    return x.withColumn("cost", usd(F.col("cost")))


_DIMS = ["account_uuid", "model", "day", "week", "month", "project", "machine_id"]


def _dims(t):
    week = F.date_format(F.date_trunc("week", F.to_date("day")), "yyyy-MM-dd")
    return t.calls.where("project IS NOT NULL").withColumns({"week": week, "month": F.substring("day", 1, 7)})


@query("WITH c AS (SELECT *, strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d') AS week, substr(day, 1, 7) AS month FROM calls WHERE project IS NOT NULL), " + "u AS (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS key, sum(cost) AS c, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(n_calls) AS BIGINT) AS n_calls FROM c GROUP BY {d}" for d in _DIMS
) + f") SELECT dimension, key, {_u('c')} AS cost, tokens, n_calls, round(CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY dimension) AS DOUBLE), 6) AS share FROM u")
def breakdown_dimensions(t):
    return reports.dimensions(_dims(t), _DIMS)


GROUPED = ("account_uuid", "machine_id", "project", "model", "day", "sid", "account_label")


@query(f"SELECT {', '.join(GROUPED)}, min(ts_us) AS first_us, {SUMS} FROM calls GROUP BY {', '.join(GROUPED)}")
def agg_grouped(t):
    x = t.calls.groupBy(*GROUPED).agg(F.min("ts_us").alias("first_us"), *[F.sum(m).alias(m) for m in reports.MEASURES])
    return x.withColumn("cost", usd(F.col("cost")))


_ORIGIN, _STEP = 1704844800000000, 6 * HOUR


@query(f"SELECT account_uuid, model, CAST(floor((ts_us - {_ORIGIN}) / {_STEP}.0) AS BIGINT) AS bucket, {SUMS} FROM calls GROUP BY ALL")
def agg_bucketed(t):
    """Steps from an origin; floored, so that rows before it keep to their own bucket."""
    at = F.floor((F.col("ts_us") - _ORIGIN) / F.lit(_STEP)).cast("long").alias("bucket")
    return reports.shown(reports.bucket(t.calls, "account_uuid", "model", at), "account_uuid", "model", "bucket")


@query(f"SELECT account_uuid, ts_us, {FAMILY} AS family, {_u('cost')} AS cost, cache_read, input_tokens + cache_create + cache_read AS observed FROM calls")
def agg_spend_rows(t):
    return t.calls.select("account_uuid", "ts_us", model_family(F.col("model")).alias("family"), usd(F.col("cost")).alias("cost"), "cache_read", (F.col("input_tokens") + F.col("cache_create") + F.col("cache_read")).alias("observed"))


@query("SELECT account_uuid, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(input_tokens + cache_create + cache_read) AS BIGINT) AS observed, round(CAST(sum(cache_read) AS DOUBLE) / nullif(CAST(sum(input_tokens + cache_create + cache_read) AS DOUBLE), 0), 6) AS cache_hit FROM calls GROUP BY 1")
def agg_cache_hit(t):
    observed = F.sum(F.col("input_tokens") + F.col("cache_create") + F.col("cache_read"))
    return t.calls.groupBy("account_uuid").agg(F.sum("cache_read").alias("cache_read"), observed.alias("observed"), ratio(F.sum("cache_read"), observed).alias("cache_hit"))


@query(f"""WITH c AS (SELECT account_uuid, count(*) AS n, sum(cost) AS c, arg_max(account_label, (ts_us, rid)) AS label FROM calls GROUP BY 1),
cur AS (SELECT account_uuid, arg_max(coalesce(user_tier, org_tier), from_us) AS tier, count(*) AS declared FROM account_tiers WHERE from_us <= {NOW} GROUP BY 1)
SELECT c.account_uuid, n, {_u('c')} AS cost, label, alias, tier, coalesce(declared, 0) AS declared FROM c LEFT JOIN account_aliases USING (account_uuid) LEFT JOIN cur USING (account_uuid)""")
def overview_accounts(t):
    each = t.calls.groupBy("account_uuid").agg(F.count(F.lit(1)).alias("n"), usd(F.sum("cost")).alias("cost"), F.max_by("account_label", F.struct("ts_us", "rid")).alias("label"))
    tiers = t.account_tiers.where(F.col("from_us") <= NOW).groupBy("account_uuid").agg(F.max_by(F.coalesce("user_tier", "org_tier"), "from_us").alias("tier"), F.count(F.lit(1)).alias("declared"))
    return each.join(small(t.account_aliases), "account_uuid", "left").join(tiers, "account_uuid", "left").fillna(0, ["declared"])


@query("SELECT account_uuid, arg_max(account_label, (ts_us, rid)) AS label FROM rec GROUP BY 1")
def overview_account_names(t):
    return t.rec.groupBy("account_uuid").agg(F.max_by("account_label", F.struct("ts_us", "rid")).alias("label"))


@query(f"""SELECT c.machine_id, c.project, any_value(alias) AS alias, count(*) AS n, {_u('sum(cost)')} AS cost, max(ts_us) AS last_us
FROM calls c LEFT JOIN project_aliases a ON a.machine_id = c.machine_id AND a.project = c.project WHERE c.project IS NOT NULL GROUP BY 1, 2""")
def overview_projects(t):
    each = t.calls.where("project IS NOT NULL").groupBy("machine_id", "project").agg(F.count(F.lit(1)).alias("n"), usd(F.sum("cost")).alias("cost"), F.max("ts_us").alias("last_us"))
    return each.join(small(t.project_aliases), ["machine_id", "project"], "left")


@query("SELECT r.machine_id, any_value(coalesce(label, m.machine_id)) AS label, count(*) AS n, max(ts_us) AS last_us FROM rec r LEFT JOIN machines m USING (machine_id) GROUP BY 1")
def overview_machines(t):
    """Raw counts, before dedup."""
    each = t.rec.groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("last_us"))
    return each.join(small(t.machines), "machine_id", "left").withColumn("label", F.coalesce("label", "machine_id"))


@query("SELECT count(DISTINCT account_uuid) FILTER (account_uuid <> 'unknown') > 1 AS worth_showing FROM calls")
def agg_account_split_flag(t):
    return t.calls.where("account_uuid <> 'unknown'").agg((F.count_distinct("account_uuid") > 1).alias("worth_showing"))


@query(f"""WITH x AS (SELECT c.*, d.ri FROM calls c LEFT JOIN price_dim d ON c.model = d.model AND c.ts_us >= d.from_us AND c.ts_us < d.to_us)
SELECT CAST(sum(tokens) AS BIGINT) AS processed, round(CAST(sum(cache_read) AS DOUBLE) / CAST(sum(input_tokens + cache_create + cache_read) AS DOUBLE), 6) AS cached_share,
 CAST(sum(input_tokens + cache_create) AS BIGINT) AS uncached, round(CAST(sum(output_tokens) AS DOUBLE) / count(DISTINCT day), 6) AS output_per_day,
 {_u('sum(CAST(cache_read AS DECIMAL(15,0)) * coalesce(ri, CAST(0 AS DECIMAL(14,10))))')} AS reads_at_input_price,
 round(CAST(sum(CAST(cache_read AS DECIMAL(15,0)) * coalesce(ri, CAST(0 AS DECIMAL(14,10)))) AS DOUBLE) / nullif(CAST(sum(cost) AS DOUBLE), 0), 6) AS read_multiple FROM x""")
def agg_tiles(t):
    from ..operators.pricing import asof_price

    x = asof_price(t.calls.drop("effective"), t.price_dim)
    fresh = F.col("cache_read").cast("decimal(15,0)") * F.coalesce("ri", F.lit(0).cast("decimal(14,10)"))
    return x.agg(
        F.sum("tokens").alias("processed"), ratio(F.sum("cache_read"), F.sum(F.col("input_tokens") + F.col("cache_create") + F.col("cache_read"))).alias("cached_share"),
        F.sum(F.col("input_tokens") + F.col("cache_create")).alias("uncached"), ratio(F.sum("output_tokens"), F.count_distinct("day")).alias("output_per_day"), usd(F.sum(fresh)).alias("reads_at_input_price"),
        ratio(F.sum(fresh), F.sum("cost")).alias("read_multiple"),
    )


#: Cost windows: name and first microsecond; all time has none. The session window runs to a reset in two hours, the week to one in three days.
SESSION = "s-4-2024-01-24"
STARTS = (("session_window", NOW + 2 * HOUR - 5 * HOUR), ("week", NOW - 4 * DAY), ("month", 1704067200000000), *((f"{h}h", NOW - h * HOUR) for h in (6, 12, 24, 168, 720)), ("all", None))
ROLLING = ("6h", "12h", "24h", "168h", "720h", "all")
_SCOPE = "(project IN ('proj1', 'proj2') OR cwd = '/w/proj3' OR starts_with(cwd, '/w/proj3/'))"
_WC = "coalesce(nullif(log_cost, 0), computed)"


@query(f"SELECT 'session' AS win, {_u(f'coalesce(sum({_WC}), 0)')} AS cost, CAST(NULL AS DOUBLE) AS project_cost FROM calls WHERE ts_us <= {NOW} AND sid = '{SESSION}' UNION ALL " + " UNION ALL ".join(
    f"SELECT '{n}', {_u(f'coalesce(sum({_WC}), 0)')}, " + (_u(f"coalesce(sum({_WC}) FILTER ({_SCOPE}), 0)") if n in ROLLING else "NULL") + f" FROM calls WHERE ts_us <= {NOW}" + (f" AND ts_us >= {at}" if at else "") for n, at in STARTS
))
def windows_rolling_costs(t):
    """Cost windows up to now; a logged cost of 0 gives way to the computed one. The scope is what the rules merge."""
    calls = apply_rules(t.calls, t.project_rules).withColumn("scoped", F.col("target") == "merged")
    return reports.cost_windows(calls, dict(STARTS), NOW, SESSION, ROLLING).withColumns({c: usd(F.col(c)) for c in ("cost", "project_cost")})


@query(" UNION ALL ".join(f"SELECT '{n}' AS win, {_u(f'coalesce(sum({_WC}), 0)')} AS cost FROM calls WHERE ts_us <= {NOW}" + (f" AND ts_us >= {at}" if at else "") for n, at in STARTS if n != "session_window"))
def windows_without_a_reset(t):
    """Where no session reset is known there is no session window, rather than one of cost 0."""
    x = reports.cost_windows(t.calls.withColumn("scoped", F.lit(False)), {**dict(STARTS), "session_window": 0}, NOW, None, ())
    return x.select("win", usd(F.col("cost")).alias("cost"))


_WEEK = dict(STARTS)["week"]
_FAMILIES = f"SELECT {FAMILY} AS family, sum({_WC}) AS cost FROM calls WHERE ts_us >= {_WEEK} AND ts_us <= {NOW} GROUP BY 1"


@query(f"SELECT family, {_u('cost')} AS cost FROM ({_FAMILIES}) AS x")
def windows_week_by_family(t):
    """The week window's cost by model family: the families add up to the window."""
    return reports.family_costs(t.calls, _WEEK, NOW).withColumn("cost", usd(F.col("cost")))


@query(f"SELECT account_uuid, s.model, {_u('x.cost')} AS week_cost FROM (SELECT DISTINCT account_uuid, model, {FAMILY} AS family FROM samples WHERE win = 'scoped' AND ts_us <= {NOW}) s LEFT JOIN ({_FAMILIES}) x USING (family)")
def windows_scoped_week_cost(t):
    """What a quota scoped to a model has cost: the week's cost of the model's family, null where the week has none."""
    scoped = t.samples.where((F.col("win") == "scoped") & (F.col("ts_us") <= NOW)).select("account_uuid", "model").distinct()
    families = reports.family_costs(t.calls, _WEEK, NOW)  # a row a family
    x = scoped.withColumn("family", model_family(F.col("model"))).join(F.broadcast(families), "family", "left")
    return x.select("account_uuid", "model", usd(F.col("cost")).alias("week_cost"))


@query(f"WITH f AS (SELECT DISTINCT sid, {FAMILY} AS family FROM calls) SELECT sid, {_u('sum(cost)')} AS cost, (SELECT string_agg(family, ',' ORDER BY family) FROM f WHERE f.sid = c.sid) AS families FROM calls c GROUP BY sid")
def agg_session_usage(t):
    return t.calls.groupBy("sid").agg(usd(F.sum("cost")).alias("cost"), F.concat_ws(",", F.sort_array(F.collect_set(model_family(F.col("model"))))).alias("families"))


_FX = """, fxd AS (SELECT d.date, max((f.date, f.rate)) AS s FROM (SELECT DISTINCT oslo_date AS date FROM calls) d LEFT JOIN fx_rates f ON f.rate > 0 AND CAST(f.date AS DATE) <= CAST(d.date AS DATE) AND CAST(f.date AS DATE) >= CAST(d.date AS DATE) - 10 GROUP BY 1)"""


@query("WITH" + _FX[1:] + f""" SELECT day, {_u('sum(cost)')} AS cost, round(CAST(sum(cost * fx.rate) * 1.25 AS DOUBLE), 4) AS cost_nok, round(CAST(sum(cost * fx.rate) AS DOUBLE), 4) AS cost_nok_net, coalesce(bool_or(fx.estimated), false) AS nok_estimated
FROM calls JOIN (SELECT date, s[2] AS rate, s[1] < date AND date >= (SELECT max(date) FROM fx_rates WHERE rate > 0) AS estimated FROM fxd) fx ON fx.date = oslo_date GROUP BY day""")
def agg_cost_nok(t):
    fx = _fx(t)
    x = t.calls.join(F.broadcast(fx), F.col("oslo_date") == F.col("date"))
    nok = lambda vat: F.sum(converted(F.col("cost"), F.col("rate"), vat))
    return x.groupBy("day").agg(usd(F.sum("cost")).alias("cost"), usd(nok(True), 4).alias("cost_nok"), usd(nok(False), 4).alias("cost_nok_net"), F.coalesce(F.bool_or("estimated"), F.lit(False)).alias("nok_estimated"))


def _fx(t):
    from ..operators.asof import calendar_asof

    return calendar_asof(t.fx_rates, "date", "rate", "2023-12-20", "2024-03-31", 10)


@query("WITH" + _FX[1:] + " SELECT count(*) AS n_dates, count(*) FILTER (s[2] IS NULL) AS unresolved FROM fxd")
def agg_fx_coverage(t):
    dates = t.calls.select(F.col("oslo_date").alias("date")).distinct()
    x = dates.join(F.broadcast(_fx(t)), "date", "left")
    return x.agg(F.count(F.lit(1)).alias("n_dates"), F.count_if(F.col("rate").isNull()).alias("unresolved"))


@query("WITH" + _FX[1:] + " SELECT date, CAST(s[2] AS DOUBLE) AS rate, s[1] AS rate_date, s[1] < date AND date >= (SELECT max(date) FROM fx_rates WHERE rate > 0) AS estimated FROM fxd")
def asof_fx_rate(t):
    dates = t.calls.select(F.col("oslo_date").alias("date")).distinct()
    return dates.join(F.broadcast(_fx(t)), "date", "left").select("date", F.col("rate").cast("double").alias("rate"), "rate_date", "estimated")


@query(f"""WITH d AS (SELECT day, {SHORT} AS short, sum(cost) AS c FROM calls GROUP BY ALL), top AS (SELECT short FROM d GROUP BY short ORDER BY sum(c) DESC, short LIMIT 3)
SELECT day, CASE WHEN short IN (SELECT short FROM top) THEN short ELSE 'Other' END AS short, {_u('sum(c)')} AS cost FROM d GROUP BY ALL""")
def topk_traces_other(t):
    x = reports.top_with_other(t.calls.withColumn("short", short_model(F.col("model"))), "day", "short", 3)
    return x.withColumn("cost", usd(F.col("cost")))


@query(f"SELECT count(DISTINCT sid) AS sessions, count(DISTINCT project) AS projects FROM calls WHERE ts_us > {NOW - 15 * 60_000_000} AND ts_us <= {NOW} AND project IS NOT NULL AND project <> 'proj4'")
def active_projects_15m(t):
    """Other projects with a call in the last fifteen minutes."""
    x = t.calls.where((F.col("ts_us") > NOW - 15 * 60_000_000) & (F.col("ts_us") <= NOW) & F.col("project").isNotNull() & (F.col("project") != "proj4"))
    return x.agg(F.count_distinct("sid").alias("sessions"), F.count_distinct("project").alias("projects"))
