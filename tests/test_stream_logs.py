"""Logs that streams keep by batch, with built-in functions: equal to a batch over everything, whatever the order of a batch and however often it is run."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe import registry
from tallyframe.operators import quota
from tallyframe.operators.stored import shared_path
from tallyframe.streaming import guard, state

from .conftest import SMALL

MINUTE, S = 60_000_000, 1_000_000
SAMPLE = "account_uuid string, win string, source string, ts_us long, event_id long, used_pct double, resets_at double, model string"
WINDOWS = ["session", "week", "sonnet", "scoped"]
PLANS = [("a", "session", True), ("a", "sonnet", False), ("b", "scoped", True)]


def readings():
    """Readings of three accounts: ties in time, jumps of hours, resets within and past the budget, and a window that no verdict looks at."""
    g, rows = np.random.default_rng(5), []
    for account in "abc":
        for k in range(120):
            at = int(g.integers(0, 400)) * MINUTE + (int(g.integers(0, 60)) * S if k % 3 else 0) + (k // 100) * 900 * MINUTE
            win, source = str(g.choice([*WINDOWS[:3], "other"])), str(g.choice(["stdin", "api"]))
            rows.append((account, win, source, at, len(rows), float(g.integers(0, 100)), at / 1e6 + float(g.integers(30, 6000)), None if k % 2 else "m"))
    return rows


def verdict_log(spark, batches):
    log = guard.VerdictLog(spark, shared_path(spark, "verdicts"), spark.createDataFrame(PLANS, "account_uuid string, win string, applicable boolean"), WINDOWS, 80, 95)
    for k, rows in enumerate(batches):
        for _ in range(2):  # every batch twice
            log.put(spark.createDataFrame(rows, SAMPLE), k)
    return log


def test_the_log_by_batch_equals_the_verdicts_at_every_minute(spark):
    rows = readings()
    rows.sort(key=lambda r: r[3])
    log = verdict_log(spark, [sorted(rows[:90], key=lambda r: -r[4]), rows[90:200], rows[200:201], rows[201:]])
    end = max(r[3] for r in rows)
    times = spark.createDataFrame([(a, t) for a in "abc" for m in range(end // MINUTE + 1) for t in (m * MINUTE, m * MINUTE + 7 * S + 1) if t <= end], "account_uuid string, now_us long")
    got = {(r["account_uuid"], r["now_us"]): (r["pct"], r["verdict"]) for r in guard.at_times(log.read(), times).collect()}
    each = times.withColumn("at", F.concat("account_uuid", F.lit("@"), F.col("now_us").cast("string")))
    own = spark.createDataFrame(rows, SAMPLE).where(F.col("win") != "other").join(each, "account_uuid").where("ts_us <= now_us").drop("account_uuid", "now_us").withColumnRenamed("at", "account_uuid")
    plan_at = spark.createDataFrame(PLANS, "account_uuid string, win string, applicable boolean").join(each, "account_uuid").select(F.col("at").alias("account_uuid"), "win", "applicable")
    want = {}
    for r in quota.verdicts(own, each.select(F.col("at").alias("account_uuid"), "now_us"), plan_at, WINDOWS, 80, 95).collect():
        a, now = r["account_uuid"].split("@")
        want[a, int(now)] = (r["pct"], r["verdict"])
    started = {a: min(r[3] for r in rows if r[0] == a) for a in "abc"}
    compared = [k for k in want if k[1] >= started[k[0]]]
    assert len(compared) > 3000 and {want[k][1] for k in compared} == {"stop", "unknown", "ok", "warn"}
    assert [(k, got[k], want[k]) for k in compared if got[k] != want[k]] == []
    told = {}
    for r in log.read().orderBy("account_uuid", "at_us").collect():  # only changes are told
        assert told.get(r["account_uuid"]) != (r["pct"], r["verdict"]) and r["n_late"] == 0
        told[r["account_uuid"]] = (r["pct"], r["verdict"])


def test_a_late_reading_changes_nothing_and_one_of_the_last_instant_counts(spark):
    row = lambda ts, event, used: ("c", "session", "stdin", ts * S, event, used, 1e6, None)
    log = verdict_log(spark, [[row(1000, 1, 50.0)], [row(1000, 2, 90.0), row(999, 3, 99.0)], [row(1010, 4, 10.0)], [row(4000, 5, 1.0)]])
    said = [(r["at_us"], r["pct"], r["verdict"], r["n_late"]) for r in log.read().orderBy("at_us").collect()]
    assert said == [(1000 * S, 90.0, "warn", 1), (1010 * S, 10.0, "ok", 1), (1910 * S + 1, None, "unknown", 1), (4000 * S, 1.0, "ok", 1)]


def test_a_busy_account_is_dealt_by_hours(spark):
    """20,000 readings of one account are one group of a state in Spark, and 6 of hours here."""
    rows = spark.range(20_000).select(
        F.lit("c").alias("account_uuid"), F.lit("session").alias("win"), F.lit("api").alias("source"), (F.col("id") * S).alias("ts_us"), F.col("id").alias("event_id"),
        (F.col("id") * 7 % 100).cast("double").alias("used_pct"), F.lit(1e6).alias("resets_at"), F.lit(None).cast("string").alias("model"),
    )
    log = guard.VerdictLog(spark, shared_path(spark, "verdicts"), spark.createDataFrame(PLANS, "account_uuid string, win string, applicable boolean"), WINDOWS, 80, 95)
    log.put(rows, 0)
    got = log.read().select("at_us", "pct").collect()
    assert sorted((r["at_us"] // S, r["pct"]) for r in got) == [(k, float(k * 7 % 100)) for k in range(20_000)]


@pytest.mark.parametrize("name", ["stream_quota_verdict", "stream_warn_once"])
def test_no_account_is_one_group_of_state(spark, monkeypatch, name):
    """A state by account leaves a task an account, however many readings it has."""
    from tallyframe.streaming import guard as module

    monkeypatch.setattr(module, "verdict_stream", None)
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_an_instance_is_warned_of_once(spark):
    log = guard.WarningLog(spark, shared_path(spark, "warnings"), 80)
    batches = [[("a", "session", "s", 5, 2, 85.0, 60.0, None), ("a", "session", "s", 5, 1, 95.0, 61.0, None), ("a", "session", "s", 4, 3, 79.0, 60.0, None)], [("a", "session", "s", 9_000 * S, 4, 99.0, 60.0, None), ("a", "session", "s", 9, 5, 81.0, 60.0, "")]]
    for k, rows in enumerate(batches):
        for _ in range(2):
            log.put(spark.createDataFrame(rows, SAMPLE), k)
    got = sorted((r["model"] is None, r["reset_min"], r["at_us"], r["pct"]) for r in log.read().collect())
    assert got == [(False, 60, 9, 81.0), (True, 60, 5, 95.0)]


# -- sums of sessions

READ = "sid string, ts_us long, rid long, total_in long, fresh long, cache_create long, cache_read long"
DAY = 86_400_000_000


def by_rule(rows):
    """sid -> (last total that counted, sums, n): a reading counts when its total differs from the one before."""
    want, last = {}, {}
    for sid, ts, rid, total, *values in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if sid not in last or last[sid] != total:
            _, sums, n = want.get(sid, (None, (0, 0, 0), 0))
            want[sid] = (total, tuple(a + b for a, b in zip(sums, values)), n + 1)
        last[sid] = total
    return want


def of_lives(df):
    got = df.groupBy("sid").agg(F.max_by("total_in", "life_us").alias("t"), *[F.sum(c).alias(c) for c in ("cum_fresh", "cum_create", "cum_read", "n", "n_late")])
    return {r["sid"]: (r["t"], (r["cum_fresh"], r["cum_create"], r["cum_read"]), r["n"]) for r in got.collect()}


def test_a_session_in_several_parts_is_taken_in_order_of_time(spark):
    """More readings than Spark hands over at once (10,000), in no order."""
    g = np.random.default_rng(7)
    rows = [("s", k * 10, k, int(k // 3 % 2), 1, 2, 3) for k in range(25_000)] + [("t", k, k, 1, 1, 1, 1) for k in range(5)]
    rows = [rows[k] for k in g.permutation(len(rows))]
    path, sink = shared_path(spark, "readings"), shared_path(spark, "sums")
    spark.createDataFrame(rows, READ).coalesce(1).write.parquet(path)
    out = state.cache_accumulator_stream(spark.readStream.schema(READ).parquet(path))
    put = lambda df, e: df.write.mode("overwrite").parquet(f"{sink}/epoch={e}")
    out.writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, "marks")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    assert of_lives(spark.read.parquet(sink)) == by_rule(rows)


def test_sums_by_batch_expire_and_equal_the_rule(spark):
    """Sessions of six days in six batches, each run twice; one comes back after its life ended."""
    g, rows = np.random.default_rng(9), []
    for d in range(6):
        rows += [(f"s{k % 30}-{d // 2}", (d + 1) * DAY + int(g.integers(0, DAY)), d * 1000 + k, int(g.integers(0, 3)), k, 1, 2) for k in range(200)]
        if d in (0, 5):
            rows += [("back", (d + 1) * DAY + j, 90_000 + d * 10 + j, 7 + d + j, 1, 1, 1) for j in range(3)]
    sums = state.CacheSums(spark, shared_path(spark, "sums"), keep="2 days")
    alive = []
    for d in range(6):
        for _ in range(2):
            sums.put(spark.createDataFrame([r for r in rows if r[1] // DAY == d + 1][::-1], READ).repartition(3), d)
        alive.append(sums._alive(d).count())
    assert of_lives(sums.lives()) == by_rule(rows)
    assert sums.lives().where("sid = 'back'").count() == 2 and sums.lives().where("sid <> 'back'").groupBy("sid").count().where("count > 1").count() == 0
    assert max(alive) <= 61 < sums.lives().count()  # sessions of a few days, not of all


def test_late_readings_and_absent_totals(spark):
    """A late reading is counted and added; as in SQL a total is compared with that of the reading before, and null differs from nothing."""
    sums = state.CacheSums(spark, shared_path(spark, "sums"))
    one = [("s", 10, 1, 5, 1, 1, 1), ("s", 20, 2, None, 1, 1, 1), ("s", 30, 3, 6, 1, 1, 1), ("s", 40, 4, 7, 1, 1, 1)]
    for k, rows in enumerate([one, [("s", 35, 5, 7, 1, 1, 1), ("s", 36, 6, 8, 1, 1, 1), ("s", 50, 7, 8, 1, 1, 1)]]):
        sums.put(spark.createDataFrame(rows, READ), k)
    assert [tuple(r) for r in sums.lives().collect()] == [("s", 10, 8, 3, 3, 3, 3, 2)]


def test_sessions_are_no_groups_of_state(spark, monkeypatch):
    """A state by session hands each of them to Python."""
    monkeypatch.setattr(state, "cache_accumulator_stream", None)
    assert registry.QUERIES["stream_cache_accumulator"](spark, SMALL).count() > 0
