"""Streams that replace, restart and expire: equal to a batch over everything, and unmoved by a replay."""

from __future__ import annotations

import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import asof, quota
from tallyframe.operators.dedup import dedup_flag
from tallyframe.operators.stored import shared_path
from tallyframe.sources import logs
from tallyframe.streaming import guard, late_files, tables
from tallyframe.streaming import state as state_of


# -- late files

CALL = "rid long, machine_id string, file_path string, account_uuid string, dk string, v int"


def sending(spark, rows, sent):
    """rows: (rid, file, key, v); a key of None or '' stands for no key."""
    df = spark.createDataFrame([(r, "m", f, "a", k, v) for r, f, k, v in rows], CALL)
    return df.withColumns({"mtime_ns": F.lit(sent).cast("long"), "size": F.lit(sent).cast("long"), "sent": F.lit(sent)})


BATCHES = [
    [(1, "f1", "x", 0), (2, "f1", "y", 0), (3, "f2", "x", 0), (4, "f2", None, 0), (5, "f2", "", 0), (6, "f3", "z", 0)],
    [(11, "f1", "y", 1), (12, "f1", "w", 1)],  # x of f1 is gone: that of f2 counts now
    [(21, "f3", "w", 2), (22, "f3", "z", 2), (23, "f4", "z", 2)],
    [(31, "f2", "w", 3), (32, "f2", "", 3)],
]


@pytest.fixture
def store(spark):
    one = sending(spark, BATCHES[0], 0)
    return late_files.FileStore(spark, shared_path(spark, "late"), one.select("rid", "machine_id", "file_path", "account_uuid", "dk", "v").schema, buckets=4)


def put(spark, store, rows, epoch):
    return store.apply(*late_files.newest_sending(sending(spark, rows, epoch)), epoch)


def state(store):
    return sorted((r["rid"], r["file_path"], r["dk"], r["v"], r["is_dup"]) for r in store.current().collect())


def recompute(spark, upto):
    """Over the last sendings, all keys at once: the first to be stored counts."""
    last = {}
    for k, rows in enumerate(BATCHES[: upto + 1]):
        for f in {r[1] for r in rows}:
            last[f] = k
    kept = [(r, f, k, v, e) for e, rows in enumerate(BATCHES[: upto + 1]) for r, f, k, v in rows if last[f] == e]
    df = spark.createDataFrame([(r, f, k, v, e, "a") for r, f, k, v, e in kept], "rid long, file_path string, dk string, v int, e int, account_uuid string")
    got = dedup_flag(df.withColumn("place", F.struct("e", "rid")), "place").collect()
    return sorted((r["rid"], r["file_path"], r["dk"], r["v"], r["is_dup"]) for r in got)


def test_late_files_replace_and_flags_equal_a_recompute(spark, store):
    for k, rows in enumerate(BATCHES):
        assert put(spark, store, rows, k)
        assert state(store) == recompute(spark, k), k
        # once more with the same number: nothing moves
        assert not put(spark, store, rows, k)
        assert state(store) == recompute(spark, k), k


def test_an_attempt_that_broke_off_leaves_nothing(spark, store):
    for k, rows in enumerate(BATCHES[:2]):
        put(spark, store, rows, k)
    before = state(store)
    # all of epoch 2 is written but its commit: readers don't see it, and the next attempt replaces it
    put(spark, store, [(91, "f1", "x", 9), (92, "f9", "y", 9)], 2)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store.path}/commits/epoch=2")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    assert store.committed() == 1 and state(store) == before
    put(spark, store, BATCHES[2], 2)
    assert state(store) == recompute(spark, 2)


def test_only_touched_keys_are_decided_again(spark, store):
    for k, rows in enumerate(BATCHES):
        put(spark, store, rows, k)
    flips = spark.read.parquet(f"{store.path}/flips")
    assert sorted((r["epoch"], r["rid"], r["is_dup"]) for r in flips.select("epoch", "rid", "is_dup").collect()) == [(1, 3, False)]


def test_an_equal_fingerprint_is_passed_over(spark, store):
    put(spark, store, BATCHES[0], 0)
    rows, files = late_files.newest_sending(sending(spark, [(99, "f1", "q", 9)], 0))
    assert store.apply(rows, files, 1)
    assert state(store) == recompute(spark, 0)


def test_compaction_changes_nothing(spark, store):
    for k, rows in enumerate(BATCHES[:3]):
        put(spark, store, rows, k)
    store.compact()
    assert state(store) == recompute(spark, 2)
    put(spark, store, BATCHES[3], 3)
    assert state(store) == recompute(spark, 3)


def test_a_file_twice_in_one_batch(spark, store):
    twice = sending(spark, [(1, "f1", "x", 0), (2, "f1", "y", 0)], 0).unionByName(sending(spark, [(3, "f1", "y", 1)], 1))
    store.apply(*late_files.newest_sending(twice), 0)
    assert state(store) == [(3, "f1", "y", 1, False)]


# -- as-of by carrying forward


def test_last_known_equals_a_join_on_skewed_keys(spark):
    """A third of all facts and of the log has one key; ties, null keys and keys without a log."""
    hot = lambda n: F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.hash("id") % n).cast("string")))
    facts = spark.range(60_000).select(F.col("id"), F.when(F.col("id") % 97 != 0, hot(500)).alias("key"), (F.hash("id", F.lit(1)) % 1_000_000).cast("long").alias("ts_us"))
    log = spark.range(20_000).select(hot(600).alias("key"), (F.hash("id", F.lit(2)) % 1_000_000).cast("long").alias("from_us"), F.col("id").alias("event"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    log = log.groupBy("key", "from_us").agg(F.max(F.struct("event", "v")).alias("r")).select("key", "from_us", "r.*")
    got = asof.last_known(facts, log, ["key"], "ts_us", "from_us", ["event", "v"], parts=16)
    want = asof.asof_join(facts, asof.intervals(log, ["key"]), ["key"], broadcast_rows=10**9).select(*got.columns)
    assert got.count() == 60_000 and got.exceptAll(want).count() == 0 and got.where("event IS NULL").count() > 600
    chosen = asof.asof_join(facts, asof.intervals(log, ["key"]), ["key"], broadcast_rows=100)
    assert chosen.select(*got.columns).exceptAll(want).count() == 0


def test_no_task_of_last_known_is_twice_the_median(spark):
    facts = spark.range(600_000).select(F.col("id"), F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 20_000).alias("key"), F.col("id").alias("ts_us"))
    log = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 20_000).alias("key"), (F.col("id") * 10).alias("from_us"), F.col("id").alias("event"))
    path = shared_path(spark, "sizes")
    asof.last_known(facts, log, ["key"], "ts_us", "from_us", ["event"], parts=16).write.parquet(path)
    before = [p for p in spark.sparkContext._jvm.java.io.File(path.rsplit("/", 1)[0]).list() if p.startswith("last-known")]
    newest = max(before, key=lambda p: spark.sparkContext._jvm.java.io.File(f"{path.rsplit('/', 1)[0]}/{p}").lastModified())
    sizes = sorted(r["count"] for r in spark.read.parquet(f"{path.rsplit('/', 1)[0]}/{newest}").groupBy("__part").count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]


# -- verdicts with timers


def test_verdict_log_equals_the_batch_at_every_minute(spark):
    minute, s = 60_000_000, 1_000_000
    g = np.random.default_rng(3)
    rows, n = [], 0
    for account in ("a", "b", "c"):
        for k in range(40):
            at = int(g.integers(0, 400)) * minute + int(g.integers(0, 60)) * s
            win, source = str(g.choice(["session", "week", "sonnet"])), str(g.choice(["stdin", "api"]))
            reset = at / 1e6 + float(g.integers(30, 6000))
            rows.append((account, win, source, at, n, float(g.integers(0, 100)), reset, None))
            n += 1
    rows.sort(key=lambda r: r[3])
    schema = "account_uuid string, win string, source string, ts_us long, event_id long, used_pct double, resets_at double, model string"
    path = shared_path(spark, "readings")
    for part in range(6):  # six batches, in order of time
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(path)
    plans = {"a": {"session": True, "sonnet": False}, "b": {"scoped": True}}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    log = guard.verdict_stream(stream, plans, ["session", "week", "sonnet", "scoped"], 80, 95)
    sink = shared_path(spark, "verdicts")
    put = lambda df, e: df.write.mode("overwrite").parquet(f"{sink}/epoch={e}")
    log.writeStream.option("checkpointLocation", shared_path(spark, "marks")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    changes = spark.read.parquet(sink)
    end = max(r[3] for r in rows)
    times = spark.createDataFrame([(a, m * minute + 7) for a in "abc" for m in range(0, end // minute)], "account_uuid string, now_us long")
    got = {(r["account_uuid"], r["now_us"]): (r["pct"], r["verdict"]) for r in guard.at_times(changes, times).collect()}
    samples, want = spark.createDataFrame(rows, schema), {}
    flat = spark.createDataFrame([(a, w, x) for a, p in plans.items() for w, x in p.items()], "account_uuid string, win string, applicable boolean")
    each = times.withColumn("at", F.concat("account_uuid", F.lit("@"), F.col("now_us").cast("string")))
    # every (account, minute) as an account of its own, so that one batch answers all
    own = samples.join(each, "account_uuid").where("ts_us <= now_us").select("at", *[c for c in samples.columns if c != "account_uuid"]).withColumnRenamed("at", "account_uuid")
    plan_at = flat.join(each, "account_uuid").select(F.col("at").alias("account_uuid"), "win", "applicable")
    for r in quota.verdicts(own, each.select(F.col("at").alias("account_uuid"), "now_us"), plan_at, ["session", "week", "sonnet", "scoped"], 80, 95).collect():
        a, now = r["account_uuid"].split("@")
        want[a, int(now)] = (r["pct"], r["verdict"])
    started = {a: min(r[3] for r in rows if r[0] == a) for a in "abc"}
    compared = [k for k in want if k[1] >= started[k[0]]]
    assert len(compared) > 800 and {want[k][1] for k in compared} >= {"stop", "unknown", "ok", "warn"}
    assert [k for k in compared if got[k] != want[k]] == []
    warned = sorted((r["account_uuid"], r["win"], r["reset_min"], r["at_us"]) for r in changes.where("kind = 'warning'").collect())
    first = {}
    for r in rows:
        if r[5] >= 80:
            first.setdefault((r[0], r[1], round(r[6] / 60) * 60), r[3])
    assert warned == sorted((*k, v) for k, v in first.items())


def test_a_late_reading_is_counted(spark):
    row = lambda ts, used: guard_row(ts, used)
    a = guard.Account(None, {}, ["session"], 80, 95)
    out = []
    a.take([row(1_000_000_000, 50.0)], out)
    assert [x[3] for x in out] == ["ok"]
    a.move(1_000_000_000 + 901_000_000, out)
    assert [x[3] for x in out] == ["ok", "unknown"] and out[-1][0] == 1_000_000_000 + 900_000_001
    held = guard.Account(a.held(), {}, ["session"], 80, 95)
    assert held.turns() == [t for t in (int(1e15),) if t > held.clock] and held.verdict == "unknown" and held.pct is None


def guard_row(ts, used):
    return SimpleNamespace(ts_us=ts, win="session", source="stdin", event_id=1, used_pct=used, resets_at=1e9, model="", reset_min=10**9, far=False)


# -- state that expires


def test_session_state_expires_and_sums_stay(spark):
    """Each day has its own sessions, one comes back long after: state holds the live ones alone, and the sums are those of all readings."""
    day, rows = 86_400_000_000, []
    for d in range(12):
        for k in range(20):
            rows += [(f"s{d}-{k}", (d + 1) * day + j * 1000, d * 1000 + k * 10 + j, 5 + (j + k) % 3, j, 1, 2) for j in range(4)]
        if d in (0, 10):
            rows += [("back", (d + 1) * day + j, 90_000 + d * 10 + j, 7 + j, 1, 1, 1) for j in range(3)]
    schema = "sid string, ts_us long, rid long, total_in long, fresh long, cache_create long, cache_read long"
    path, sink = shared_path(spark, "readings"), shared_path(spark, "sums")
    for d in range(12):
        spark.createDataFrame([r for r in rows if r[1] // day == d + 1], schema).coalesce(1).write.mode("append").parquet(path)
    out = state_of.cache_accumulator_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), keep="2 days")
    put = lambda df, e: df.write.mode("overwrite").parquet(f"{sink}/epoch={e}")
    q = out.writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, "marks")).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) <= 20 * 5 + 1 < 241  # sessions of a few days, not of all
    got = spark.read.parquet(sink).groupBy("sid", "life_us").agg(F.max_by(F.struct("cum_fresh", "cum_create", "cum_read", "n"), "epoch").alias("r")).groupBy("sid").agg(F.sum("r.cum_fresh").alias("f"), F.sum("r.n").alias("n"), F.count(F.lit(1)).alias("lives"))
    got = {r["sid"]: (r["f"], r["n"], r["lives"]) for r in got.collect()}
    want = {}
    for sid, _, _, total, fresh, _, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        last, f, n = want.get(sid, (None, 0, 0))
        want[sid] = (total, f + fresh, n + 1) if total != last else (last, f, n)
    assert {k: v[:2] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}
    assert got["back"][2] == 2 and len(got) == 241


def test_keyless_calls_cost_once_each(spark):
    rows = [("s", 1, 10, "k", "f#1"), ("s", 2, 10, "k", "f#2"), ("s", 3, 5, None, "f#3"), ("s", 4, 5, None, "f#4"), ("s", 4, 5, None, "f#4")]
    path, sink = shared_path(spark, "calls"), shared_path(spark, "costs")
    spark.createDataFrame(rows, "sid string, ts_us long, micros long, ident string, place string").coalesce(1).write.parquet(path)
    out = state_of.session_cost_stream(spark.readStream.schema("sid string, ts_us long, micros long, ident string, place string").parquet(path))
    out.writeStream.outputMode("update").option("checkpointLocation", shared_path(spark, "marks")).trigger(availableNow=True).foreachBatch(lambda df, e: df.write.mode("overwrite").parquet(f"{sink}/e={e}")).start().awaitTermination()
    assert [(r["micros"], r["n"]) for r in spark.read.parquet(sink).collect()] == [(20, 3)]


# -- tables that streams keep


def lines_of(spark, pieces):
    rows = [(v, log, p, k) for p, piece in enumerate(pieces) for k, (log, v) in enumerate(piece)]
    df = spark.createDataFrame(rows, "value string, file_path string, piece int, k int")
    return df.withColumn("place", F.struct("piece", "k"))


def call(mid, cwd=None):
    return json.dumps({"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "sessionId": "s", "cwd": cwd, "requestId": "r", "message": {"id": mid, "model": "m", "usage": {"input_tokens": 1}}})


def test_a_folder_that_comes_late_gives_all_calls_their_project(spark):
    """A log in four pieces names its folder in the third; another names two; a third never does."""
    a, b, c = "/logs/one/a.jsonl", "/logs/two/b.jsonl", "/logs/six/c.jsonl"
    pieces = [
        [(a, call("a1")), (b, call("b1", "/w/first/x")), (c, call("c1"))], [(a, "{broken"), (a, call("a2"))],
        [(b, call("b2", "/w/second")), (a, json.dumps({"type": "user", "cwd": "/w/late"})), (a, call("a3", "/w/other"))], [(a, call("a4")), (c, call("c2"))],
    ]
    table = tables.LogTable(spark, shared_path(spark, "logs"), ("/w",))
    seen = []
    for k in range(4):
        for _ in range(2):  # every batch twice
            table.put(lines_of(spark, pieces[: k + 1]).where(F.col("piece") == k), k)
        got = sorted((r["mid"], r["cwd"], r["project"]) for r in table.read().collect())
        whole = logs.parse_lines(lines_of(spark, pieces[: k + 1]), ("/w",))
        assert got == sorted((r["mid"], r["cwd"], r["project"]) for r in whole.collect()), k
        seen.append(dict((m, p) for m, _, p in got)["a1"])
    assert seen == ["one", "one", "late", "late"]


def test_a_snapshot_with_a_tenth_less_is_refused(spark):
    rows = lambda n, priced: spark.range(n).select("id", F.when(F.col("id") < priced, 1.0).alias("log_cost"))
    table = tables.Snapshots(spark, shared_path(spark, "snapshots"), rows(1, 1).schema)
    taken = [table.put(rows(n, priced), k) for k, (n, priced) in enumerate([(1000, 900), (900, 850), (901, 850), (901, 765), (901, 766), (5, 5)])]
    assert taken == [True, False, True, False, True, False] and table.read().count() == 901
    assert not table.put(rows(5, 5), 5) and table.put(rows(2000, 1000), 6)  # a replay says the same
    said = [(r["epoch"], r["old_rows"], r["old_costs"], r["refused"]) for r in table.report.read().orderBy("epoch").collect()]
    assert said == [(0, None, None, False), (1, 1000, 900, True), (2, 1000, 900, False), (3, 901, 850, True), (4, 901, 850, False), (5, 901, 766, True), (6, 901, 766, False)]


def test_rolling_windows_read_partials_alone(spark):
    from tallyframe import registry
    from .conftest import SMALL

    df = registry.QUERIES["stream_rolling_windows"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partials" in plan and "events" not in plan and plan.count("FileScan") == 1
    rolling = {r["win"]: r["cost"] for r in registry.QUERIES["windows_rolling_costs"](spark, SMALL).collect()}
    now = max(r["now_us"] for r in df.collect())
    got = {r["win"]: r["cost"] for r in df.collect() if r["now_us"] == now}
    assert got == {k: pytest.approx(rolling[k]) for k in got}
