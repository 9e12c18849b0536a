"""Per-key state machines as Structured Streaming queries, with their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .tables import Epochs

GATE_S = 300
_GATED = ["machine_id", "account_uuid", "win", "ts_us", "used_pct", "reset_min"]
GATE_OUT = "machine_id string, account_uuid string, win string, ts_us long, used_pct double, reset_min long"
LOGIN = ["account_uuid", "email", "organization_uuid", "organization_name", "seat_tier", "user_tier", "org_tier"]


def _passes(row, last: tuple | None) -> bool:
    """None stored, another reset, or the whole percent (halves to even) moved and five minutes gone by since the last row *kept*."""
    return last is None or row.reset_min != last[2] or (round(row.used_pct) != round(last[1]) and row.ts_us - last[0] >= GATE_S * 1_000_000)


def change_gate_batch(samples: DataFrame) -> DataFrame:
    """The gate over a stored table: each key's rows pass in time order, and only the last one kept is held."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for part in parts:
            kept = []
            for k, r in enumerate(part.itertuples(index=False)):
                if (own := (r.machine_id, r.account_uuid, r.win)) != key:
                    key, last = own, None
                if _passes(r, last):
                    kept.append(k)
                    last = (r.ts_us, r.used_pct, r.reset_min)
            yield part.iloc[kept]

    keys = _GATED[:3]
    return samples.select(*_GATED).repartition(*keys).sortWithinPartitions(*keys, "ts_us", "used_pct").mapInPandas(run, GATE_OUT)


def _stateful(rows: DataFrame, keys: list[str], order: list[str], out: str, state: str, step, mode: str) -> DataFrame:
    """``step(row, state)`` gives the new state, or None where the row changes nothing, for a key's rows in order of time.

    In append mode the rows that changed the state come out, in update mode the key's state. A row
    before one that a former batch took is late and is passed over: what was given out stays true.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, seen = (tuple(held.get)[1:], held.get[0]) if held.exists else (None, None)
        batch = pd.concat(list(parts), ignore_index=True).sort_values(order)  # one key's rows of one batch
        kept = []
        for k, r in enumerate(batch.itertuples(index=False)):
            if seen is not None and getattr(r, order[0]) < seen:
                continue
            new = step(r, now)
            if new is not None:
                now = new
                kept.append(k)
        if now is not None:
            held.update((int(max(seen or 0, batch[order[0]].max())), *now))
        yield batch.iloc[kept] if mode == "append" else pd.DataFrame([(*key, *now)] if kept else [], columns=[f.split()[0] for f in out.split(", ")])

    return rows.groupBy(*keys).applyInPandasWithState(run, out, f"seen long, {state}", mode, GroupStateTimeout.NoTimeout)


def change_gate_stream(samples: DataFrame) -> DataFrame:
    """The gate as a stream: its state is the last kept row of a key."""
    step = lambda r, last: (int(r.ts_us), float(r.used_pct), int(r.reset_min)) if _passes(r, last) else None
    return _stateful(samples.select(*_GATED), _GATED[:3], ["ts_us", "used_pct"], GATE_OUT, "ts_us long, used_pct double, reset_min long", step, "append")


def account_changes(events: DataFrame) -> DataFrame:
    """Logins of a machine that differ from the one before in any of seven fields; those without a uuid are refused."""
    before = F.lag(F.struct(*LOGIN)).over(Window.partitionBy("machine_id").orderBy("ts_us"))
    known = events.where(F.col("account_uuid").isNotNull()).withColumn("before", before)
    return known.where(F.col("before").isNull() | ~F.col("before").eqNullSafe(F.struct(*LOGIN))).select("machine_id", "ts_us", *LOGIN)


def account_changes_stream(events: DataFrame) -> DataFrame:
    """The same as a stream, whose state is the machine's last login."""
    text = ", ".join(f"{c} string" for c in LOGIN)

    def step(row, last):
        own = tuple(None if pd.isna(x) else x for x in (getattr(row, c) for c in LOGIN))
        return None if own == last else own

    known = events.where(F.col("account_uuid").isNotNull()).select("machine_id", "ts_us", *LOGIN)
    return _stateful(known, ["machine_id"], ["ts_us"], f"machine_id string, ts_us long, {text}", text, step, "append")


CACHE = "total_in long, cum_fresh long, cum_create long, cum_read long, n long"
#: Extra readings and sessions are kept this long at the source.
KEEP = "31 days"


def cache_accumulator_stream(readings: DataFrame, keep: str = KEEP, delay: str = "0 seconds") -> DataFrame:
    """A session's running sums; a reading counts only when its input total differs from the one before.

    A session that the watermark leaves ``keep`` behind loses its state. ``life_us`` tells its lives
    apart, should it go on later: what was given out for one life stays, and a session's sums are
    those of its lives together. A reading older than one that a former batch took is counted in
    ``n_late`` and, as anything that came, added when its total differs from the last one held.
    """
    out = [f.split()[0] for f in f"sid string, life_us long, {CACHE}, n_late long".split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        life, seen, total, *sums, n, late = held.get if held.exists else (None, -1, None, 0, 0, 0, 0, 0)
        newest = seen
        batch = pd.concat(list(parts), ignore_index=True).sort_values(["ts_us", "rid"])  # one session's readings of one batch: parts are in no order
        for r in batch.itertuples(index=False):
            life = int(r.ts_us) if life is None else life
            late += int(r.ts_us) < seen
            newest = max(newest, int(r.ts_us))
            if total != r.total_in:
                total, n = int(r.total_in), n + 1
                sums = [int(a + b) for a, b in zip(sums, (r.fresh, r.cache_create, r.cache_read))]
        held.update((life, newest, total, *sums, n, late))
        held.setTimeoutTimestamp(max(newest // 1000, held.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame([(*key, life, total, *sums, n, late)], columns=out)

    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = readings.select("sid", "ts_us", "rid", "total_in", "fresh", "cache_create", "cache_read", F.timestamp_micros("ts_us").alias("ts")).withWatermark("ts", delay)
    state = f"life_us long, seen long, {CACHE}, n_late long"
    return rows.groupBy("sid").applyInPandasWithState(run, f"sid string, life_us long, {CACHE}, n_late long", state, "update", GroupStateTimeout.EventTimeTimeout)


SUMS = "cum_fresh long, cum_create long, cum_read long, n long, n_late long"


class CacheSums:
    """The same sums by batch with built-in functions: ``epoch=E`` in the folder ``path`` holds the sessions alive after batch E, and those whose life it ended.

    A batch and the sessions alive before it are dealt by session once and passed in order of time, so no
    reading is handed to Python and no state lies in memory. ``last_in`` is the total of a session's last
    reading. The two newest epochs keep their living sessions, as an epoch that is run again starts from the one before it.
    """

    def __init__(self, spark: SparkSession, path: str, keep: str = KEEP):
        self.spark, self.keep_us = spark, int(pd.Timedelta(keep).total_seconds()) * 1_000_000
        self.kept = Epochs(spark, path, T.StructType.fromDDL(f"sid string, life_us long, seen_us long, last_in long, total_in long, {SUMS}, closed boolean"))

    def _alive(self, epoch: int) -> DataFrame:
        return self.kept.read().where((F.col("epoch") == epoch) & ~F.col("closed")).drop("epoch", "closed")

    def put(self, batch: DataFrame, epoch: int) -> None:
        """Adds the readings (sid, ts_us, rid, total_in, fresh, cache_create, cache_read) of a batch."""
        before = self._alive(epoch - 1)
        newest = before.agg(F.max("seen_us")).first()[0]
        over = F.col("seen_us") < F.lit((newest or 0) - self.keep_us)
        read = batch.where("ts_us IS NOT NULL").select(
            "sid", F.lit(1).alias("kind"), "ts_us", "rid", F.lit(None).cast("long").alias("life_us"), F.col("total_in").alias("last_in"), "total_in",
            F.col("fresh").alias("cum_fresh"), F.col("cache_create").alias("cum_create"), F.col("cache_read").alias("cum_read"), F.lit(1).cast("long").alias("n"),
        )
        held = before.where(~over).select("sid", F.lit(0).alias("kind"), F.col("seen_us").alias("ts_us"), F.lit(None).cast("long").alias("rid"), "life_us", "last_in", "total_in", "cum_fresh", "cum_create", "cum_read", "n", "n_late")
        order = Window.partitionBy("sid").orderBy("kind", "ts_us", "rid")
        held_at = F.max(F.when(F.col("kind") == 0, F.col("ts_us"))).over(order)
        x = read.withColumn("n_late", F.lit(0).cast("long")).unionByName(held).withColumns({"i": F.row_number().over(order), "b": F.lag("last_in").over(order), "held_at": held_at})
        new, counts = F.col("kind") == 1, F.coalesce((F.col("kind") == 0) | (F.col("i") == 1) | (F.col("b") != F.col("last_in")), F.lit(False))
        late = F.when(new & (F.col("ts_us") < F.col("held_at")), 1).otherwise(F.col("n_late"))
        sums = [F.sum(F.when(counts, F.col(c))).alias(c) for c in ("cum_fresh", "cum_create", "cum_read")]
        after = x.groupBy("sid").agg(
            F.coalesce(F.max("life_us"), F.min("ts_us")).alias("life_us"), F.max("ts_us").alias("seen_us"), F.max_by("last_in", "i").alias("last_in"),
            F.max_by("total_in", F.when(counts & F.col("total_in").isNotNull(), F.col("i"))).alias("total_in"), *sums,
            F.sum(F.when(counts, F.col("n")).otherwise(0)).alias("n"), F.sum(late).alias("n_late"),
        )
        self.kept.put(after.withColumn("closed", F.lit(False)).unionByName(before.where(over).withColumn("closed", F.lit(True))), epoch, "closed")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.kept.path}/epoch={epoch - 2}/closed=false")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def lives(self) -> DataFrame:
        """A row for each life of a session: those that ended and those that go on."""
        rows = self.kept.read()
        newest = rows.where("NOT closed").agg(F.max("epoch")).first()[0]
        return rows.where(F.col("closed") | (F.col("epoch") == newest)).drop("seen_us", "last_in", "closed", "epoch")


def follow_readings(readings: DataFrame, sums: CacheSums, checkpoint: str):
    """A query that adds each batch of the stream ``readings`` to ``sums`` under its number."""
    return readings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sums.put)


def active_projects_stream(records: DataFrame, delay: str = "40 days") -> DataFrame:
    """Sessions and projects with a call in each fifteen minutes, a window every five."""
    timed = records.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", "15 minutes", "5 minutes")).agg(
        F.size(F.collect_set("sid")).alias("sessions"), F.size(F.collect_set("project")).alias("projects")
    ).select(F.unix_micros("window.end").alias("until_us"), "sessions", "projects")


def session_cost_stream(records: DataFrame, delay: str = "40 days") -> DataFrame:
    """Running cost of a session over appended calls, each call once; a call without an identity stands for itself. Emits in update mode.

    Identities are held until the watermark passes them. Calls without one go by their own file and
    place (``place``), so a line that is sent again is still the same line.
    """
    timed = records.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)
    own = F.when(F.col("ident").isNotNull(), F.concat(F.lit("i:"), "ident")).otherwise(F.concat(F.lit("p:"), "place"))
    once = timed.withColumn("own", own).dropDuplicatesWithinWatermark(["own"])
    return once.groupBy("sid").agg(F.sum("micros").alias("micros"), F.count(F.lit(1)).alias("n"))


def minute_costs_stream(records: DataFrame, delay: str = "40 days") -> DataFrame:
    """Costs by minute, from which rolling totals are summed at read."""
    timed = records.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", "1 minute")).agg(F.sum("micros").alias("micros"), F.count(F.lit(1)).alias("n")).select(F.unix_micros("window.start").alias("minute_us"), "micros", "n")
