"""Quota verdicts as a stream with timers: an account's verdict changes when a reading comes, when one grows too old, and when a reset passes.

The state of an account is the newest reading of each window and source, and the window instances
that were warned of. Between two readings nothing arrives, but time does its work: a reading is
fresh up to its budget and counts as 0 from its reset on. These instants are worked through in order,
those up to the next reading with it, the others by an event-time timer as the watermark passes them.
The output is a log of changes: ``verdict`` rows hold from ``at_us`` on, a ``warning`` row is the first
of its instance. Readings older than what an account's clock has passed are late; they change nothing
and are counted in ``n_late`` of the account's next row.

``verdict_stream`` keeps an account's state in Spark and walks its readings one by one, so it serves few
readings at a time. ``VerdictLog`` gives the same log by batch with built-in functions: the newest readings lie
beside it, a batch is dealt by hours of each account, and a busy account fills many tasks. ``WarningLog``
gives the warnings in the same way.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import quota
from ..operators.asof import small
from .tables import Epochs

OUT = "account_uuid string, at_us long, kind string, pct double, verdict string, win string, model string, reset_min long, n_late long"
STATE = "clock_us long, n_late long, pct double, verdict string, readings string, warned string"
#: Microseconds behind its reset after which a warned instance is forgotten.
FORGET_US = 3_600_000_000
#: Width of the stretches by which ``VerdictLog`` deals an account's readings.
BIN_US = 3_600_000_000


class Account:
    """One account's readings and what they say at its clock."""

    def __init__(self, held: tuple | None, plan: dict[str, bool], windows: list[str], warn: float, stop: float):
        self.clock, self.late, self.pct, self.verdict, readings, warned = held or (-1, 0, None, None, "{}", "{}")
        self.readings: dict[str, list] = json.loads(readings)  # "win|source" -> [ts_us, event_id, used, resets_at, budget_us]
        self.warned: dict[str, int] = json.loads(warned)
        self.plan, self.windows, self.warn, self.stop = plan, windows, warn, stop
        self.pct = None if self.pct is None or math.isnan(self.pct) else self.pct

    def held(self) -> tuple:
        return self.clock, self.late, float("nan") if self.pct is None else self.pct, self.verdict, json.dumps(self.readings), json.dumps(self.warned)

    def turns(self) -> list[int]:
        """When readings will be too old or their resets pass."""
        return [t for ts, _, _, resets, budget in self.readings.values() for t in (ts + budget + 1, math.ceil(resets * 1e6)) if t > self.clock]

    def says(self, now: int) -> tuple[float | None, str]:
        fresh: dict[str, list[float]] = {}
        for name, (ts, _, used, resets, budget) in self.readings.items():
            values = fresh.setdefault(name.split("|")[0], [])
            if now - ts <= budget:
                values.append(0.0 if resets <= now / 1e6 else used)
        shown = [w for w in self.windows if fresh.get(w) or (self.plan.get(w) is not False and (w in fresh or self.plan.get(w)))]
        known = [max(fresh[w]) for w in self.windows if fresh.get(w)]
        top = max(known, default=None)
        if not shown or (top is not None and top >= self.stop):
            return top, "stop"
        if any(not fresh.get(w) for w in shown):
            return top, "unknown"
        return top, "warn" if top >= self.warn else "ok"

    def move(self, to: int, out: list) -> None:
        """The clock goes on to ``to``, by way of every instant that may change the verdict."""
        for at in sorted({t for t in self.turns() if t < to} | {to}):
            self.clock = at
            if (now := self.says(at)) != (self.pct, self.verdict):
                self.pct, self.verdict = now
                out.append((at, "verdict", *now, None, None, None))

    def take(self, rows: list, out: list) -> None:
        """Readings of one instant."""
        at = int(rows[0].ts_us)
        self.move(at - 1, out) if at - 1 > self.clock and self.readings else None
        for r in rows:
            name, budget = f"{r.win}|{r.source}", quota.FRESH.get(r.source, quota.FRESH["api"]) * 1_000_000
            if name not in self.readings or self.readings[name][:2] <= [at, int(r.event_id)]:
                self.readings[name] = [at, int(r.event_id), float(r.used_pct), float(r.resets_at), budget]
            if r.used_pct >= self.warn and not r.far and (key := f"{r.win}|{r.model or ''}|{r.reset_min}") not in self.warned:
                self.warned[key] = int(r.reset_min)
                out.append((at, "warning", float(r.used_pct), None, r.win, r.model, int(r.reset_min)))
        self.warned = {k: m for k, m in self.warned.items() if m * 1_000_000 + FORGET_US > at}
        self.move(at, out)


def verdict_stream(samples: DataFrame, plans: dict[str, dict[str, bool]], windows: list[str], warn: float, stop: float, delay: str = "0 seconds") -> DataFrame:
    """``samples`` as a stream; ``plans`` has what each account's plan says of a window, a few rows an account."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        account = Account(tuple(state.get) if state.exists else None, plans.get(key[0], {}), windows, warn, stop)
        out: list[tuple] = []
        if state.hasTimedOut:
            account.move(state.getCurrentWatermarkMs() * 1000, out)
        else:
            batch = pd.concat(list(parts), ignore_index=True).sort_values(["ts_us", "event_id"])  # one account's readings of one batch
            late = batch["ts_us"] < account.clock
            account.late += int(late.sum())
            for _, rows in batch[~late].groupby("ts_us", sort=True):
                account.take(list(rows.itertuples(index=False)), out)
        state.update(account.held())
        if ahead := account.turns():
            state.setTimeoutTimestamp(max(-(-min(ahead) // 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *x, account.late) for x in out], columns=[f.split()[0] for f in OUT.split(", ")])

    rows = samples.select(
        "account_uuid", "win", "source", "ts_us", "event_id", "used_pct", "resets_at", F.coalesce("model", F.lit("")).alias("model"),
        quota.reset_minute().alias("reset_min"), quota.is_placeholder().alias("far"), F.timestamp_micros("ts_us").alias("ts"),
    )
    return rows.withWatermark("ts", delay).groupBy("account_uuid").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def budget_us(source: str = "source") -> Column:
    """Microseconds up to which a reading counts as fresh, by where it came from."""
    known = F.lit(quota.FRESH["api"])
    for name, s in quota.FRESH.items():
        known = F.when(F.col(source) == name, s).otherwise(known)
    return known.cast("long") * 1_000_000


def _reset_us() -> Column:
    """The first microsecond at which a reset has passed; null for one that never will."""
    r, c = F.ceil(F.col("resets_at") * 1e6), F.col("resets_at")
    return F.when(F.abs(c) < 1e12, F.when(c <= (r - 1) / 1e6, r - 1).when(c <= r / 1e6, r).otherwise(r + 1)).cast("long")


READING = "account_uuid string, win string, source string, ts_us long, event_id long, used_pct double, resets_at double"


class VerdictLog:
    """The log of verdicts in the folder ``path``, a folder an epoch for each of its tables.

    * ``log``: ``verdict`` rows as of ``verdict_stream``; ``since_us`` is where the epoch's stretch of time begins;
    * ``held``: the newest reading of each account, window and source;
    * ``clock``: up to when the log has been written, the newest reading of all accounts;
    * ``late``: readings so far that came after the clock had passed them, by account.

    An epoch reads what the one before it left, so a second attempt gives the same. Between its readings'
    own times a verdict changes only when one of them grows too old or its reset passes. All these instants are
    dealt by account and ``BIN_US``; the readings in force when a stretch begins are carried into it, and the newest of
    each window and source says the rest. Instants of readings that a newer one has replaced change nothing.
    ``plans`` (account_uuid, win, applicable) has a few rows an account; sources are a few names.
    """

    def __init__(self, spark: SparkSession, path: str, plans: DataFrame, windows: list[str], warn: float, stop: float):
        self.plans, self.windows, self.warn, self.stop = plans, windows, warn, stop
        table = lambda name, schema: Epochs(spark, f"{path.rstrip('/')}/{name}", T.StructType.fromDDL(schema))
        self.log = table("log", "account_uuid string, at_us long, kind string, pct double, verdict string, n_late long, since_us long")
        self.held, self.clock, self.late = table("held", READING), table("clock", "clock_us long"), table("late", "account_uuid string, n_late long")

    def _says(self, force: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
        """``pct`` and ``verdict`` at ``at_us`` of the readings in force (``s0``, ``s1``, ...) and what the plan says of each window (``p0``, ...)."""
        most = lambda values: F.greatest(*values) if len(values) > 1 else values[0]
        value = lambda r: F.when(F.col("at_us") - r["ts_us"] <= r["budget"], F.when(r["resets_at"] <= F.col("at_us") / 1e6, 0.0).otherwise(r["used_pct"]))
        each = range(len(self.windows))
        series = [[F.col(f"s{k}") for k, (x, _) in enumerate(names) if x == w] for w in self.windows]
        fresh = force.withColumns({f"f{w}": most([value(r) for r in series[w]]) for w in each} | {f"r{w}": F.coalesce(*series[w]).isNotNull() for w in each})
        shown = {f"w{w}": F.col(f"f{w}").isNotNull() | F.coalesce(f"p{w}", F.lit(True)) & (F.col(f"r{w}") | F.coalesce(f"p{w}", F.lit(False))) for w in each}
        seen = fresh.withColumns(shown | {"pct": most([F.col(f"f{w}") for w in each])})
        no, over = F.lit(False), lambda line: F.coalesce(F.col("pct") >= line, F.lit(False))
        some = reduce(or_, [F.col(f"w{w}") for w in each], no)
        open_ = reduce(or_, [F.col(f"w{w}") & F.col(f"f{w}").isNull() for w in each], no)
        return seen.withColumn("verdict", F.when(~some | over(self.stop), "stop").when(open_, "unknown").when(over(self.warn), "warn").otherwise("ok"))

    def put(self, batch: DataFrame, epoch: int) -> None:
        """The log goes on by the readings of ``batch`` and up to the newest of them."""
        last = self.clock.read().where(F.col("epoch") == epoch - 1).first()
        since = last["clock_us"] if last else None
        read = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.held.schema.fields[:-1]]).where("account_uuid IS NOT NULL AND ts_us IS NOT NULL")
        upto, sources = read.agg(F.max("ts_us"), F.collect_set(F.coalesce("source", F.lit("")))).first()
        upto = max((x for x in (since, upto) if x is not None), default=None)
        in_time = F.lit(True) if since is None else F.col("ts_us") >= since
        before = self.held.read().where(F.col("epoch") == epoch - 1).drop("epoch")
        sources = sorted({*sources, *(r[0] for r in before.select(F.coalesce("source", F.lit(""))).distinct().collect())})
        late = self.late.read().where(F.col("epoch") == epoch - 1).drop("epoch").unionByName(read.where(~in_time).groupBy("account_uuid").agg(F.count(F.lit(1)).alias("n_late")))
        self.late.put(late.groupBy("account_uuid").agg(F.sum("n_late").alias("n_late")), epoch)
        names = [(w, s) for w in self.windows for s in sources]
        if upto is not None and names:
            known = read.where(in_time).withColumn("kind", F.lit(1)).unionByName(before.withColumn("kind", F.lit(0)))
            number = F.lit(None).cast("int")
            for k, (w, s) in enumerate(names):
                number = F.when((F.col("win") == w) & (F.coalesce("source", F.lit("")) == s), k).otherwise(number)
            known = known.withColumns({"budget": budget_us(), "series": number, "bin": F.floor(F.col("ts_us") / BIN_US)})
            # of one instant's readings of a series the one with the highest event_id counts; what was held was said, whatever replaces it now
            own = Window.partitionBy("account_uuid", "bin", "win", "source").orderBy("ts_us", "event_id")
            each = known.withColumn("next", F.lead("ts_us").over(own)).where((F.col("kind") == 0) | F.col("next").isNull() | (F.col("next") > F.col("ts_us"))).persist()
            try:
                self.log.put(self._changes(each, names, since, upto, epoch), epoch)
                newest = F.max_by(F.struct("ts_us", "event_id", "used_pct", "resets_at"), F.struct("ts_us", "event_id")).alias("r")
                self.held.put(each.where("next IS NULL").groupBy("account_uuid", "win", "source").agg(newest).select("account_uuid", "win", "source", "r.*"), epoch)
            finally:
                each.unpersist()
        self.clock.put(batch.sparkSession.range(1).select(F.lit(upto).cast("long").alias("clock_us")).where("clock_us IS NOT NULL"), epoch)

    def _changes(self, each: DataFrame, names: list[tuple[str, str]], since: int | None, upto: int, epoch: int) -> DataFrame:
        """The verdicts that change in [since, upto]; ``kind`` 0 stands for what was known and said before, and ``next`` is the series' next reading in its bin."""
        reading = F.struct("ts_us", "budget", "used_pct", "resets_at")
        keys, cols = ["account_uuid", "bin"], ["account_uuid", "bin", "at_us", "kind", "series", "reading"]
        none, number = F.lit(None).cast("struct<ts_us:long,budget:long,used_pct:double,resets_at:double>"), F.lit(None).cast("int")
        instant = each.select(
            "account_uuid", "series", "kind", reading.alias("reading"),
            F.explode(F.array_compact(F.array(F.struct(F.col("ts_us").alias("at_us"), F.lit(True).alias("taken")), *[
                F.when((turn > F.col("ts_us")) & (turn <= F.col("ts_us") + F.col("budget") + 1) & (turn <= upto) & (F.col("next").isNull() | (turn < F.col("next"))) & (turn > (F.lit(-1) if since is None else since)), F.struct(turn.alias("at_us"), F.lit(False).alias("taken")))
                for turn in (_reset_us(), F.col("ts_us") + F.col("budget") + 1)
            ]))).alias("i"),
        )
        taken = F.col("i.taken")
        rows = instant.select(
            "account_uuid", F.floor(F.col("i.at_us") / BIN_US).alias("bin"), F.col("i.at_us").alias("at_us"), F.when(taken, F.col("kind")).otherwise(1).alias("kind"),
            F.when(taken, F.coalesce("series", F.lit(-1))).alias("series"), F.when(taken, F.col("reading")).alias("reading"),
        )
        if since is not None:  # what each account was told last
            told = each.where("kind = 0").select("account_uuid").distinct()
            rows = rows.unionByName(told.select("account_uuid", F.floor(F.lit(since) / BIN_US).alias("bin"), F.lit(since).alias("at_us"), F.lit(0).alias("kind"), number.alias("series"), none.alias("reading")))
        # the readings in force when a stretch of an account begins; series -1 stands for windows that no verdict looks at
        marks = range(-1, len(names))
        last = each.where("next IS NULL").withColumn("series", F.coalesce("series", F.lit(-1)))
        newest = lambda k: F.max_by(F.when(F.col("series") == k, F.struct(reading.alias("reading"))), F.when(F.col("series") == k, F.struct("ts_us", "event_id")))
        ends = rows.select(*keys).distinct().join(last.groupBy(*keys).agg(*[newest(k).alias(f"e{k + 1}") for k in marks]), keys, "left")
        earlier = Window.partitionBy("account_uuid").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        brought = ends.select(*keys, *[F.last(f"e{k + 1}", ignorenulls=True).over(earlier).alias(f"e{k + 1}") for k in marks])
        brought = brought.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("series"), F.col(f"e{k + 1}").alias("r")) for k in marks])).alias("b"))
        carried = brought.where("b.r IS NOT NULL").select(*keys, (F.col("bin") * BIN_US - 1).alias("at_us"), F.lit(0).alias("kind"), F.col("b.series").alias("series"), F.col("b.r.reading").alias("reading"))
        order, place = Window.partitionBy(*keys).orderBy("at_us", "kind"), F.struct("at_us", "kind")
        upto_now = order.rowsBetween(Window.unboundedPreceding, 0)
        force = rows.select(*cols).unionByName(carried.select(*cols)).withColumns(
            {f"s{k}": F.last(F.when(F.col("series") == k, F.col("reading")), ignorenulls=True).over(upto_now) for k in range(len(names))} | {"later": F.lead(place).over(order)}
        ).where(F.col("later").isNull() | (F.col("later") != place))  # all of an instant's readings are in
        said_by = [F.max(F.when(F.col("win") == w, F.col("applicable"))).alias(f"p{k}") for k, w in enumerate(self.windows)]
        applies = self.plans.groupBy(F.col("account_uuid").alias("__account")).agg(*said_by)
        force = force.join(small(applies), F.col("account_uuid") == F.col("__account"), "left")
        said = self._says(force, names).select(*keys, "at_us", "kind", "pct", "verdict").withColumn("before", F.lag(F.struct("pct", "verdict")).over(order))
        new = said.where((F.col("kind") == 1) & (F.col("before").isNull() | ~F.col("before").eqNullSafe(F.struct("pct", "verdict"))))
        late = self.late.read().where(F.col("epoch") == epoch).select(F.col("account_uuid").alias("__late"), "n_late")
        return new.join(small(late), F.col("account_uuid") == F.col("__late"), "left").select(
            "account_uuid", "at_us", F.lit("verdict").alias("kind"), "pct", "verdict", F.coalesce("n_late", F.lit(0).cast("long")).alias("n_late"), F.lit(since).cast("long").alias("since_us")
        )

    def read(self) -> DataFrame:
        """The log. What an epoch says of the instant at which the one before it ended stands in place of what that said."""
        log = self.log.read()
        again = log.where("at_us = since_us").select(F.col("account_uuid").alias("__a"), F.col("at_us").alias("__at"), F.col("epoch").alias("__e"))
        replaced = (F.col("account_uuid") == F.col("__a")) & (F.col("at_us") == F.col("__at")) & (F.col("epoch") < F.col("__e"))
        return log.join(small(again), replaced, "left_anti").drop("since_us", "epoch")


class WarningLog:
    """The warnings in the folder ``path``: of each window instance the first reading at or over ``warn``, told once.

    The warnings of former epochs are what it remembers, so an instance is never told of twice.
    """

    KEYS = ("account_uuid", "win", "model", "reset_min")

    def __init__(self, spark: SparkSession, path: str, warn: float):
        self.warn = warn
        self.log = Epochs(spark, path, T.StructType.fromDDL("account_uuid string, win string, model string, reset_min long, at_us long, pct double"))

    def put(self, batch: DataFrame, epoch: int) -> None:
        over = batch.where((F.col("used_pct") >= self.warn) & ~quota.is_placeholder()).withColumn("reset_min", quota.reset_minute())
        first = over.groupBy(*self.KEYS).agg(F.min(F.struct("ts_us", "event_id", "used_pct")).alias("r")).select(*self.KEYS, F.col("r.ts_us").alias("at_us"), F.col("r.used_pct").alias("pct"))
        told = self.log.read().where(F.col("epoch") < epoch).select(*[F.col(k).alias(f"__{k}") for k in self.KEYS])
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.KEYS]
        self.log.put(first.join(told, same, "left_anti"), epoch)

    def read(self) -> DataFrame:
        return self.log.read().drop("epoch")


def follow(samples: DataFrame, log: VerdictLog | WarningLog, checkpoint: str):
    """A query that hands each batch of the stream ``samples`` to ``log`` under its number."""
    return samples.writeStream.option("checkpointLocation", checkpoint).foreachBatch(log.put)


def at_times(changes: DataFrame, times: DataFrame) -> DataFrame:
    """(account_uuid, now_us, pct, verdict): what the log of changes says at each row of ``times`` (account_uuid, now_us), by one ordered pass a key."""
    from ..operators.asof import last_known

    log = changes.where("kind = 'verdict'").select("account_uuid", "at_us", "pct", "verdict")
    return last_known(times, log, ["account_uuid"], "now_us", "at_us", ["pct", "verdict"])
