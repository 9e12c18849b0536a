"""Streams over the record and sample tables, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixtures import DAY, HOUR, NOW
from ..functions.money import usd
from ..functions.names import dedup_identity
from ..operators import quota
from ..operators.stored import shared_path, written
from ..registry import query
from ..streaming import guard, late_files, state, tables
from ..operators.attribution import apply_rules
from .quota import GUARDED, ORACLE_VERDICT, ORACLE_WARN, STOP, WARN
from .report_queries import _SCOPE, _WC, _u


BATCHES = 3


def stream_of(t, df: DataFrame, name: str) -> DataFrame:
    """The frame written as files, one for each stretch of time, and read as a stream of as many batches."""
    path, whole = shared_path(t.spark, name), written(df, f"{name}-whole")
    low, high = whole.agg(F.min("ts_us"), F.max("ts_us")).first()
    width = ((high or 0) - (low or 0)) // BATCHES + 1
    for k in range(BATCHES):
        own = (F.col("ts_us") >= (low or 0) + k * width) & (F.col("ts_us") < (low or 0) + (k + 1) * width)
        whole.where(own).coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_to_end(t, out: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs until the source is used up; in update mode the last row of each key counts.

    An epoch has a folder of its own, which a second attempt at it replaces.
    """
    sink, marks = shared_path(t.spark, "sink"), shared_path(t.spark, "marks")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    q = out.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(write).queryName(f"q{uuid.uuid4().hex}").start()
    q.awaitTermination()
    got = t.spark.read.schema(T.StructType([*out.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(sink)
    if keys:
        rest = [c for c in out.columns if c not in keys]
        got = got.groupBy(*keys).agg(*[F.max_by(c, "epoch").alias(c) for c in rest])
    return got.select(*out.columns)



_GATE = """WITH RECURSIVE s AS (SELECT machine_id, account_uuid, win, ts_us, used_pct, CAST(round_even(resets_at / 60, 0) * 60 AS BIGINT) AS reset_min FROM samples WHERE NOT resets_at - ts_us / 1000000.0 > 8 * 86400),
passed AS (SELECT machine_id, account_uuid, win, min((ts_us, used_pct, reset_min)) AS r FROM s GROUP BY 1, 2, 3 UNION ALL
 SELECT s.machine_id, s.account_uuid, s.win, min((s.ts_us, s.used_pct, s.reset_min)) FROM passed k JOIN s ON s.machine_id = k.machine_id AND s.account_uuid = k.account_uuid AND s.win = k.win
 AND (s.ts_us, s.used_pct) > (k.r[1], k.r[2]) AND (s.reset_min <> k.r[3] OR round_even(s.used_pct, 0) <> round_even(k.r[2], 0) AND s.ts_us - k.r[1] >= 300000000) GROUP BY 1, 2, 3)
SELECT machine_id, account_uuid, win, r[1] AS ts_us, r[2] AS used_pct, r[3] AS reset_min FROM passed"""


def _gated(t):
    return t.samples.where(~quota.is_placeholder()).withColumn("reset_min", quota.reset_minute()).select("machine_id", "account_uuid", "win", "ts_us", "used_pct", "reset_min")


@query(_GATE)
def stream_change_gate(t):
    return run_to_end(t, state.change_gate_stream(stream_of(t, _gated(t), "samples")), "append")


@query(_GATE)
def batch_change_gate(t):
    """The gate over the stored table; both are compared with the rule as a recursive query."""
    return state.change_gate_batch(_gated(t))


@query("SELECT sid, CAST(sum(CAST(floor(cost * 1000000) AS BIGINT)) AS BIGINT) AS micros, count(*) AS n FROM calls GROUP BY sid")
def stream_session_cost(t):
    """Calls of which a third is sent again; those without a key cost, too, each line once."""
    keyed = t.calls.select("sid", "ts_us", (F.floor(F.col("cost") * 1_000_000)).cast("long").alias("micros"), F.when(F.col("dk") != "", dedup_identity()).alias("ident"), F.concat_ws("#", "file_path", F.col("rid").cast("string")).alias("place"))
    twice = keyed.unionByName(keyed.where(F.col("ts_us") % 3 == 0))  # sent again
    return run_to_end(t, state.session_cost_stream(stream_of(t, twice, "calls")), "update", ["sid"])


@query("SELECT ts_us // 60000000 * 60000000 AS minute_us, CAST(sum(CAST(floor(cost * 1000000) AS BIGINT)) AS BIGINT) AS micros, count(*) AS n FROM calls GROUP BY 1")
def stream_minute_costs(t):
    rows = t.calls.select("ts_us", (F.floor(F.col("cost") * 1_000_000)).cast("long").alias("micros"))
    return run_to_end(t, state.minute_costs_stream(stream_of(t, rows, "minutes")), "update", ["minute_us"])


_LOGIN = ", ".join(state.LOGIN)
_CHANGES = f"""SELECT machine_id, ts_us, {_LOGIN} FROM (SELECT *, row({_LOGIN}) AS own, lag(row({_LOGIN})) OVER w AS b, row_number() OVER w AS i FROM account_events WHERE account_uuid IS NOT NULL
 WINDOW w AS (PARTITION BY machine_id ORDER BY ts_us)) WHERE i = 1 OR own IS DISTINCT FROM b"""


@query(_CHANGES)
def scd_account_changes(t):
    """The login log: a row where any of seven fields differs from the login before."""
    return state.account_changes(t.account_events)


@query(_CHANGES)
def stream_account_changes(t):
    return run_to_end(t, state.account_changes_stream(stream_of(t, t.account_events, "logins")), "append")


@query("""WITH x AS (SELECT *, input_tokens + cache_create AS total_in, lag(input_tokens + cache_create) OVER w AS b, row_number() OVER w AS i FROM rec WINDOW w AS (PARTITION BY sid ORDER BY ts_us, rid))
SELECT sid, arg_max(total_in, i) AS total_in, CAST(sum(input_tokens) AS BIGINT) AS cum_fresh, CAST(sum(cache_create) AS BIGINT) AS cum_create, CAST(sum(cache_read) AS BIGINT) AS cum_read, count(*) AS n, CAST(0 AS BIGINT) AS n_late
FROM x WHERE i = 1 OR b <> total_in GROUP BY 1""")
def stream_cache_accumulator(t):
    rows = t.rec.select("sid", "ts_us", "rid", (F.col("input_tokens") + F.col("cache_create")).alias("total_in"), F.col("input_tokens").alias("fresh"), "cache_create", "cache_read")
    kept = state.CacheSums(t.spark, shared_path(t.spark, "sums"))
    state.follow_readings(stream_of(t, rows, "readings"), kept, shared_path(t.spark, "marks")).trigger(availableNow=True).start().awaitTermination()
    sums = [F.sum(c).alias(c) for c in ("cum_fresh", "cum_create", "cum_read", "n", "n_late")]
    return kept.lives().groupBy("sid").agg(F.max_by("total_in", "life_us").alias("total_in"), *sums)


@query("""WITH x AS (SELECT sid, project, unnest(generate_series(ts_us // 300000000 + 1, ts_us // 300000000 + 3)) * 300000000 AS until_us FROM rec WHERE project IS NOT NULL AND project <> 'proj4')
SELECT until_us, CAST(count(DISTINCT sid) AS INTEGER) AS sessions, CAST(count(DISTINCT project) AS INTEGER) AS projects FROM x GROUP BY 1""")
def stream_active_projects(t):
    """Other projects with a call in the last fifteen minutes, every five."""
    rows = t.rec.where("project IS NOT NULL AND project <> 'proj4'").select("sid", "project", "ts_us")
    return run_to_end(t, state.active_projects_stream(stream_of(t, rows, "active")), "update", ["until_us"])


#: Which sending of its file is the last, and up to when each sending has calls.
_LAST = "CASE WHEN file % 5 = 0 THEN 3 WHEN file % 3 = 1 THEN 2 WHEN file % 3 = 0 THEN 1 ELSE 0 END"
_UPTO = (NOW - 15 * DAY, NOW - 10 * DAY, NOW - 5 * DAY, NOW)
_SENT = ("file >= 0", "file % 3 = 0", "file % 3 = 1", "file % 5 = 0")


def sendings(t) -> DataFrame:
    """Whole files as they come: all of them early on, then some again, longer, in three late batches."""
    rows = t.rec.select("rid", "machine_id", "file_path", "account_uuid", "dk", "ts_us", "input_tokens", F.regexp_extract("file_path", "([0-9]+)", 1).cast("int").alias("file"))
    each = [rows.where(f"({own}) AND ts_us < {upto}").withColumn("sent", F.lit(k)) for k, (own, upto) in enumerate(zip(_SENT, _UPTO))]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out.withColumns({"mtime_ns": F.col("sent").cast("long"), "size": F.lit(_UPTO[0]).cast("long") + F.col("sent")}).drop("file")


def stored_late(t) -> late_files.FileStore:
    """The stream of sendings, one a batch, stored."""
    rows = sendings(t)
    path = shared_path(t.spark, "sendings")
    for k in range(len(_SENT)):
        rows.where(F.col("sent") == k).coalesce(1).write.mode("append").parquet(path)
    kept = T.StructType([f for f in rows.schema.fields if f.name not in ("mtime_ns", "size", "sent")])
    store = late_files.FileStore(t.spark, shared_path(t.spark, "late"), kept, buckets=8)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    late_files.follow(stream, store, shared_path(t.spark, "marks")).trigger(availableNow=True).start().awaitTermination()
    return store


@query(f"""WITH f AS (SELECT *, CAST(regexp_extract(file_path, '[0-9]+') AS INTEGER) AS file FROM rec), l AS (SELECT *, {_LAST} AS last FROM f),
k AS (SELECT * FROM l WHERE ts_us < CASE last {" ".join(f"WHEN {n} THEN {us}" for n, us in enumerate(_UPTO))} END)
SELECT rid, machine_id, file_path, account_uuid, dk, ts_us, input_tokens, coalesce(dk, '') <> '' AND row_number() OVER (PARTITION BY account_uuid, dk ORDER BY last, rid) > 1 AS is_dup FROM k""")
def stream_late_files(t):
    """What the store holds after files came late in three batches: equal to a full recompute over the last sendings."""
    return stored_late(t).current()


def _followed(t, log):
    """``log`` after all samples have come as a stream."""
    rows = t.samples.select("account_uuid", "win", "source", "ts_us", "event_id", "used_pct", "resets_at", "model")
    guard.follow(stream_of(t, rows, "samples"), log, shared_path(t.spark, "marks")).trigger(availableNow=True).start().awaitTermination()
    return log.read()


@query(ORACLE_VERDICT.replace(GUARDED.format(now=NOW), f"(SELECT account_uuid, max(ts_us) AS now_us FROM samples WHERE ts_us <= {NOW} GROUP BY 1)"))
def stream_quota_verdict(t):
    """The verdict of each account at its newest reading, read off the log that a stream of the samples gives."""
    names = [r["win"] for r in t.window_spans.orderBy("ord").select("win").collect()]
    log = _followed(t, guard.VerdictLog(t.spark, shared_path(t.spark, "verdicts"), t.plan_windows, names, WARN, STOP))
    times = t.samples.where(F.col("ts_us") <= NOW).groupBy("account_uuid").agg(F.max("ts_us").alias("now_us"))
    return guard.at_times(log, times).select("account_uuid", "pct", "verdict")


@query(ORACLE_WARN)
def stream_warn_once(t):
    """One warning a window instance, however many readings are over the line."""
    log = _followed(t, guard.WarningLog(t.spark, shared_path(t.spark, "warnings"), WARN))
    return log.select("account_uuid", "win", "model", "reset_min", F.col("at_us").alias("first_warned_us"))


_NOWS = (NOW, NOW - 3 * DAY, NOW - 11 * DAY - 7 * 60_000_000)
_ROLL = (6, 12, 24, 168, 720)


@query(" UNION ALL ".join(
    f"SELECT CAST({now} AS BIGINT) AS now_us, '{n}' AS win, {_u(f'coalesce(sum({_WC}), 0)')} AS cost, {_u(f'coalesce(sum({_WC}) FILTER ({_SCOPE}), 0)')} AS project_cost FROM calls WHERE ts_us < {now}" + (f" AND ts_us >= {now - h * HOUR}" if h else "")
    for now in _NOWS for n, h in [*((f"{h}h", h) for h in _ROLL), ("all", None)]))
def stream_rolling_windows(t):
    """Rolling totals at three times, read off minute partials that a stream keeps: no call is read again."""
    calls = apply_rules(t.calls, t.project_rules).select("ts_us", "machine_id", "target", "log_cost", "computed")
    kept = tables.Epochs(t.spark, shared_path(t.spark, "partials"), tables.PARTIAL)
    tables.follow_minutes(stream_of(t, calls, "costs"), kept, shared_path(t.spark, "marks")).trigger(availableNow=True).start().awaitTermination()
    return tables.rolling_windows(kept.read(), list(_NOWS), _ROLL, "merged").withColumns({c: usd(F.col(c)) for c in ("cost", "project_cost")})


_KEPT = ("true", "machine_id <> 'm2'", "rid % 50 <> 0", "true")
_COUNTS = ", ".join(f"count(*) FILTER ({c}) AS r{k}, count(log_cost) FILTER ({c}) AS c{k}" for k, c in enumerate(_KEPT))


@query(f"""WITH cnt AS (SELECT {_COUNTS} FROM rec), snap AS (SELECT 0 AS epoch, r0 AS n_rows, c0 AS n_costs, CAST(NULL AS BIGINT) AS old_rows, CAST(NULL AS BIGINT) AS old_costs FROM cnt UNION ALL SELECT 1, r1, c1, r0, c0 FROM cnt UNION ALL SELECT 2, r2, c2, r0, c0 FROM cnt UNION ALL SELECT 3, r3, c3, r2, c2 FROM cnt)
SELECT CAST(epoch AS BIGINT) AS epoch, n_rows, n_costs, old_rows, old_costs, coalesce(old_rows >= 100 AND n_rows <= old_rows * 0.9 OR old_costs >= 100 AND n_costs <= old_costs * 0.9, false) AS refused FROM snap""")
def stream_drop_guard(t):
    """Four snapshots as a stream: one without a machine is refused and held back, the next is compared with the last good one."""
    path, rows = shared_path(t.spark, "snapshots"), t.rec.select("rid", "machine_id", "log_cost")
    for own in _KEPT:
        rows.where(own).coalesce(1).write.mode("append").parquet(path)
    kept = tables.Snapshots(t.spark, shared_path(t.spark, "guarded"), rows.schema)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    tables.follow_snapshots(stream, kept, shared_path(t.spark, "marks")).trigger(availableNow=True).start().awaitTermination()
    return kept.report.read()
