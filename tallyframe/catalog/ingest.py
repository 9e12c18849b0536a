"""Sources, sinks, merges and deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import DAY, NOW
from ..functions.money import usd
from ..operators.attribution import apply_rules, asof_account
from ..operators.pricing import asof_price
from ..operators.reports import bucket, shown, with_models
from ..operators.stored import shared_path
from ..registry import query
from ..sources import ingest, logs
from ..streaming import tables
from .attribution import LABELS, TARGET
from .calls import SLIM, SLIM_SQL
from .report_queries import SUMS

_TEN = 1704844800000000
#: What arrives: machine m2's files, early calls only of two of them.
BATCH = f"machine_id = 'm2' AND (ts_us >= {_TEN} OR file_path IN ('/p/4.jsonl', '/p/5.jsonl'))"
STORED = "file_path IN ('/p/0.jsonl', '/p/1.jsonl', '/p/2.jsonl', '/p/6.jsonl')"
VERDICTS = f"""b AS (SELECT r.*, effective FROM rec r LEFT JOIN price_dim d ON r.model = d.model AND ts_us >= d.from_us AND ts_us < d.to_us WHERE {BATCH}),
ver AS (SELECT machine_id, file_path, CASE WHEN {STORED} THEN 'skipped' WHEN bool_or(effective IS NULL AND NOT contains(model, ':') AND NOT starts_with(model, '<')) THEN 'rejected' ELSE 'accepted' END AS verdict FROM b GROUP BY 1, 2)"""


def _batch(t):
    return asof_price(t.rec.where(BATCH), t.price_dim)


def _verdicts(t):
    return ingest.file_verdicts(_batch(t), t.inventory, t.inventory.where(STORED))


@query(f"WITH {VERDICTS} SELECT * FROM ver")
def ingest_file_verdicts(t):
    return _verdicts(t)


@query(f"""WITH {VERDICTS} SELECT {SLIM_SQL}, false AS fresh FROM rec r WHERE NOT EXISTS (SELECT 1 FROM ver v WHERE verdict = 'accepted' AND v.machine_id = r.machine_id AND v.file_path = r.file_path)
UNION ALL SELECT {SLIM_SQL}, true FROM rec r WHERE {BATCH} AND EXISTS (SELECT 1 FROM ver v WHERE verdict = 'accepted' AND v.machine_id = r.machine_id AND v.file_path = r.file_path)""")
def ingest_replace_files(t):
    old, new = t.rec.select(*SLIM, F.lit(False).alias("fresh")), t.rec.where(BATCH).select(*SLIM, F.lit(True).alias("fresh"))
    return ingest.replace_files(old, new, _verdicts(t))


@query("""SELECT rid, day, oslo_date, round(CAST(log_cost AS DOUBLE), 6) AS log_cost, round(CAST(computed AS DOUBLE), 6) AS priced FROM calls""")
def ingest_stamp_records(t):
    """Server price, the machine's own day and Oslo's, the logged cost kept apart."""
    offset = F.when(F.col("machine_id") == "m1", 3600).when(F.col("machine_id") == "m2", -18000).otherwise(0)
    at = F.timestamp_micros(F.col("ts_us") + offset.cast("long") * 1_000_000)
    oslo = F.from_utc_timestamp(F.timestamp_micros("ts_us"), "Europe/Oslo")
    return t.calls.select("rid", F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(oslo, "yyyy-MM-dd").alias("oslo_date"), usd(F.col("log_cost")).alias("log_cost"), usd(F.col("computed")).alias("priced"))


# a reading sent again has the same machine, window and instant; every fourth comes once more with a later account
_AGAIN = "event_id % 4 = 0"


@query(f"SELECT machine_id, win, ts_us, arg_max(used_pct, o) AS used_pct, arg_max(account_uuid, o) AS account_uuid FROM (SELECT machine_id, win, ts_us, used_pct, account_uuid, event_id AS o FROM samples UNION ALL SELECT machine_id, win, ts_us, used_pct + 1, 'acct-later', event_id + 1000000000 FROM samples WHERE {_AGAIN}) GROUP BY 1, 2, 3")
def ingest_upsert_samples(t):
    """The last write of a (machine, window, instant): two readings of one minute both stay."""
    x = t.samples.select("machine_id", "win", "ts_us", "used_pct", "account_uuid", F.col("event_id").cast("long").alias("o"))
    again = t.samples.where(_AGAIN).select("machine_id", "win", "ts_us", F.col("used_pct") + 1, F.lit("acct-later"), F.col("event_id").cast("long") + 1_000_000_000)
    return ingest.upsert(x.union(again), ["machine_id", "win", "ts_us"], "o").drop("o")


@query(f"SELECT machine_id, ts_us, arg_max(spent_cents, o) AS spent_cents FROM (SELECT machine_id, ts_us, spent_cents, event_id AS o FROM extra UNION ALL SELECT machine_id, ts_us, spent_cents + 5, event_id + 1000000000 FROM extra WHERE {_AGAIN}) GROUP BY 1, 2")
def ingest_upsert_extra(t):
    """The last write of a (machine, instant)."""
    x = t.extra.select("machine_id", "ts_us", "spent_cents", F.col("event_id").cast("long").alias("o"))
    again = t.extra.where(_AGAIN).select("machine_id", "ts_us", F.col("spent_cents") + 5, F.col("event_id").cast("long") + 1_000_000_000)
    return ingest.upsert(x.union(again), ["machine_id", "ts_us"], "o").drop("o")


@query("SELECT file_path, mtime_ns, size FROM inventory WHERE archived = 1 OR file_path IN ('/p/3.jsonl', '/p/8.jsonl')")
def src_changed_files(t):
    """Stored fingerprints miss the archived files and are stale for two others."""
    stale = F.col("file_path").isin("/p/3.jsonl", "/p/8.jsonl")
    stored = t.inventory.where("archived = 0").withColumn("mtime_ns", F.when(stale, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns")))
    return ingest.changed_files(t.inventory, stored).select("file_path", "mtime_ns", "size")


@query(f"SELECT {SLIM_SQL} FROM rec WHERE file_path IN ('/p/3.jsonl', '/p/11.jsonl')")
def src_orphaned_records(t):
    live = t.inventory.where("file_path NOT IN ('/p/3.jsonl', '/p/11.jsonl')")
    return ingest.orphans(t.rec, live).select(*SLIM)


@query(f"SELECT file_path FROM inventory WHERE archived = 0 AND NOT ({STORED})")
def delta_unacked_files(t):
    return ingest.changed_files(t.inventory.where("archived = 0"), t.inventory.where(STORED)).select("file_path")


@query(f"SELECT event_id, win, ts_us, used_pct FROM samples WHERE ts_us > {NOW - DAY}")
def delta_new_samples(t):
    return t.samples.where(F.col("ts_us") > NOW - DAY).select("event_id", "win", "ts_us", "used_pct")


@query(f"""WITH {TARGET}, {LABELS}, iv AS (SELECT *, coalesce(lead(ts_us) OVER (PARTITION BY machine_id ORDER BY ts_us), 9223372036854775807) AS to_us FROM lab)
SELECT rid, target AS project, coalesce(i.account_uuid, 'unknown') AS account_uuid, CASE r.machine_id WHEN 'm1' THEN 3600 WHEN 'm2' THEN -18000 ELSE 0 END AS utc_offset FROM tgt r LEFT JOIN iv i ON r.machine_id = i.machine_id AND r.ts_us >= i.ts_us AND r.ts_us < i.to_us""")
def delta_payload_records(t):
    x = asof_account(apply_rules(t.rec, t.project_rules), t.account_events)
    offset = F.when(F.col("machine_id") == "m1", 3600).when(F.col("machine_id") == "m2", -18000).otherwise(0)
    return x.select("rid", F.col("target").alias("project"), F.col("login_uuid").alias("account_uuid"), offset.alias("utc_offset"))


@query("SELECT event_id, date, rate, rate BETWEEN 5 AND 20 AS kept FROM fx_observations")
def src_fx_clean(t):
    """Observations in the plausible band, and those outside it apart."""
    good, bad = logs.clean_rates(t.fx_observations)
    return good.withColumn("kept", F.lit(True)).unionByName(bad.withColumn("kept", F.lit(False)))


@query("""WITH kept_rows AS (SELECT * FROM account_events WHERE NOT (source = 'backfill' AND account_uuid = 'acct-2'))
SELECT * FROM kept_rows UNION ALL SELECT * FROM declared_timeline WHERE ts_us NOT IN (SELECT ts_us FROM kept_rows)""")
def ingest_replace_timeline(t):
    """One account's declared rows anew; those at a capture's time give way."""
    return ingest.replace_timeline(t.account_events, t.declared_timeline, "acct-2")


@query("""SELECT rid, round(CAST(cost AS DOUBLE), 6) AS cost, tokens, model FROM calls""")
def sink_record_export(t):
    """One object a call, as JSON lines; read back for comparison."""
    out = shared_path(t.spark, "export")
    rows = t.calls.select("rid", usd(F.col("cost")).alias("cost"), "tokens", "model")
    rows.write.json(out)
    return t.spark.read.schema(rows.schema).json(out)


@query(f"""SELECT day, CAST(sum(tokens) AS BIGINT) AS tokens, round(CAST(sum(cost) AS DOUBLE), 6) AS cost, CAST(sum(n_calls) AS BIGINT) AS n_calls,
 CAST(count(DISTINCT model) FILTER (model <> '<synthetic>') AS INTEGER) AS n_models FROM calls GROUP BY day""")
def sink_report_nested(t):
    """Each day's report as one nested object, written as JSON lines; read back for comparison."""
    b = with_models(t.calls, "day")
    out = shared_path(t.spark, "nested")
    b.select(F.to_json(F.struct("day", "tokens", usd(F.col("cost")).alias("cost"), "n_calls", "models")).alias("value")).write.text(out)
    back = t.spark.read.schema("day string, tokens long, cost double, n_calls long, models map<string, double>").json(out)
    return back.select("day", "tokens", "cost", "n_calls", F.size("models").alias("n_models"))


def _log_files(t, pieces: int = 1) -> str:
    """Log files as the tool writes them, from the records, with bad and other lines among them; returns their root."""
    iso = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    usage = F.struct("input_tokens", "output_tokens", F.col("cache_create").alias("cache_creation_input_tokens"), F.when(F.col("cache_read") > 0, F.col("cache_read")).alias("cache_read_input_tokens"))
    line = F.to_json(F.struct(
        F.lit("assistant").alias("type"), iso.alias("timestamp"), F.col("sid").alias("sessionId"), "cwd", F.try_element_at(F.split("dk", ":"), F.lit(2)).alias("requestId"),
        F.col("log_cost").cast("string").alias("costUSD"), F.struct(F.col("mid").alias("id"), "model", usage.alias("usage")).alias("message")))
    other = F.when(F.col("rid") % 50 == 0, F.lit("{broken")).when(F.col("rid") % 50 == 2, F.lit('{"type":"user","cwd":"/w/user"}'))
    root = shared_path(t.spark, "logs")
    lines = t.rec.select(F.regexp_extract("file_path", "([0-9]+)", 1).alias("log"), "rid", F.posexplode(F.array_compact(F.array(line, other))).alias("k", "value"))
    top = t.rec.agg(F.max("rid")).first()[0] or 0
    for piece in range(pieces):
        own = lines.where((F.col("rid") * pieces >= piece * (top + 1)) & (F.col("rid") * pieces < (piece + 1) * (top + 1))) if pieces > 1 else lines
        own.repartition("log").sortWithinPartitions("log", "rid", "k").select("log", "value").write.partitionBy("log").text(f"{root}/piece={piece}" if pieces > 1 else root)
    return root


_PARSED = """WITH named AS (SELECT file_path, rid, 0 AS k, cwd FROM rec WHERE cwd IS NOT NULL UNION ALL SELECT file_path, rid, 1, '/w/user' FROM rec WHERE rid % 50 = 2),
 first AS (SELECT file_path, arg_min(cwd, (rid, k)) AS cwd FROM named GROUP BY 1)
SELECT ts_us, sid, mid, model, nullif(dk, '') AS dk, round(CAST(log_cost AS DOUBLE), 6) AS log_cost, input_tokens, output_tokens, cache_create, cache_read, f.cwd,
 coalesce(nullif(regexp_extract(f.cwd, '^/w/([^/]+)', 1), ''), 'log=' || regexp_extract(r.file_path, '[0-9]+')) AS project FROM rec r LEFT JOIN first f USING (file_path)"""
_SHOWN = ("ts_us", "sid", "mid", "model", "dk", "log_cost", "input_tokens", "output_tokens", "cache_create", "cache_read", "cwd", "project")


@query(_PARSED)
def stream_session_logs(t):
    """Logs that arrive in four pieces as a stream: what the batch gives over whole logs."""
    root, table = _log_files(t, 4), tables.LogTable(t.spark, shared_path(t.spark, "log-table"), ("/w",))
    name = lambda piece: F.regexp_replace(piece, "^.*/(log=[0-9]+)/[^/]*$", "/$1/log")
    tables.follow_logs(t.spark, root, table, shared_path(t.spark, "marks"), name, "*.txt", 20).trigger(availableNow=True).start().awaitTermination()
    return table.read().withColumn("log_cost", usd(F.col("log_cost"))).select(*_SHOWN)


@query(_PARSED)
def src_parse_session_logs(t):
    calls = logs.parse_lines(logs.read_lines(t.spark, _log_files(t), "*.txt"), ("/w",))
    return calls.withColumn("log_cost", usd(F.col("log_cost"))).select(*_SHOWN)


@query(None)
def src_log_inventory(t):
    """The bytes of each log folder, from the listing alone."""
    files = logs.inventory(t.spark, _log_files(t), "*.txt")
    return files.groupBy(F.regexp_extract("file_path", "log=([0-9]+)", 1).alias("log")).agg(F.sum("size").alias("size"))


@query("""SELECT event_id, CAST(floor(used_pct + 0.5) AS INTEGER) AS session_percent, 's' || event_id AS session_reset, CASE WHEN event_id % 3 > 0 THEN CAST(floor(used_pct) AS INTEGER) END AS week_percent,
 CASE WHEN event_id % 3 = 1 THEN 'w' || event_id END AS week_reset, CASE WHEN win = 'sonnet' THEN CAST(floor(used_pct + 0.25) AS INTEGER) END AS sonnet_percent, CASE WHEN win = 'sonnet' THEN 'n' || event_id END AS sonnet_reset,
 CASE WHEN model IS NOT NULL THEN CAST(floor(used_pct + 0.9) AS INTEGER) END AS scoped_percent, model AS scoped_model, CASE WHEN model IS NOT NULL THEN 'm' || event_id END AS scoped_reset,
 CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS INTEGER) END AS extra_percent, CASE WHEN event_id % 2 = 0 THEN event_id % 5000 / 100.0 END AS extra_spent, CASE WHEN event_id % 2 = 0 AND event_id % 5 > 0 THEN 50.0 END AS extra_limit FROM samples""")
def src_quota_payload(t):
    """Response bodies as the service writes them, some with other limits before the scoped one, and back to columns."""
    n = F.col("event_id")
    tag = lambda x: F.concat(F.lit(x), n.cast("string"))
    quota = lambda used, reset: F.struct(used.alias("utilization"), reset.alias("resets_at"))
    limit = lambda kind, percent, name: F.struct(
        F.lit(kind).alias("kind"), percent.alias("percent"), tag("m").alias("resets_at"), F.struct(F.struct(name.alias("display_name")).alias("model")).alias("scope"))
    used, none = F.col("used_pct"), F.lit(None)
    limits = F.when(F.col("model").isNotNull(), F.array(
        limit("weekly_all", F.lit(1.0), F.lit("all")), limit("weekly_scoped", none.cast("double"), F.lit("without a percent")), limit("weekly_scoped", F.lit(2.0), none.cast("string")),
        limit("weekly_scoped", used + 0.9, F.col("model")), limit("weekly_scoped", F.lit(3.0), F.lit("second"))))
    body = F.struct(
        quota(used + 0.5, tag("s")).alias("five_hour"), quota(F.when(n % 3 > 0, used), F.when(n % 3 == 1, tag("w")).otherwise("")).alias("seven_day"),
        F.when(F.col("win") == "sonnet", quota(used + 0.25, tag("n"))).alias("seven_day_sonnet"), limits.alias("limits"),
        F.when(n % 2 == 0, F.struct((n % 100).alias("utilization"), (n % 5000).alias("used_credits"), F.when(n % 5 > 0, 5000).alias("monthly_limit"))).alias("extra_usage"))
    return logs.parse_quota(t.samples.select("event_id", F.to_json(body).alias("body")))


@query("SELECT source, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM (SELECT 'live' AS source, input_tokens FROM rec WHERE file_path NOT IN ('/p/3.jsonl', '/p/11.jsonl') UNION ALL SELECT 'orphan', input_tokens FROM rec WHERE file_path IN ('/p/3.jsonl', '/p/11.jsonl')) GROUP BY 1")
def union_all_sources(t):
    gone = F.col("file_path").isin("/p/3.jsonl", "/p/11.jsonl")
    live, orphan = t.rec.where(~gone).withColumn("source", F.lit("live")), t.rec.where(gone).withColumn("source", F.lit("orphan"))
    return live.unionByName(orphan).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"))


@query(f"SELECT day, {SUMS} FROM calls GROUP BY day")
def report_from_stored_flag(t):
    """The daily report by way of the stored flag: no dedup shuffle and no pricing at read."""
    return shown(bucket(t.flagged.where(~F.col("is_dup")), "day"), "day")
