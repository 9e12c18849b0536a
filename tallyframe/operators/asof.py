"""As-of joins on change logs: a log becomes intervals, and facts look up the one they fall in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import written

FOREVER = 9223372036854775807
#: Rows of a dimension up to which it is broadcast; a larger one is joined by key with a shuffle.
BROADCAST_ROWS = 20_000
#: Times the average number of intervals that a key may have before bins of one width no longer fit all keys.
UNEVEN = 8


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a dimension that, counted so far, has at most ``rows`` rows; a larger one is joined with a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def intervals(log: DataFrame, keys: list[str], at: str = "from_us", end: str = "to_us") -> DataFrame:
    """[at, next at) per key."""
    later = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    return log.withColumn(end, F.coalesce(later, F.lit(FOREVER)))


def asof_join(facts: DataFrame, spans: DataFrame, keys: list[str], ts: str = "ts_us", at: str = "from_us", end: str = "to_us", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join to the interval of the key that holds ``ts``; a key's intervals don't overlap.

    Few intervals are broadcast. More are laid over bins of time, about as many as a key has
    intervals, and joined on (keys, bin): a busy key spreads over its bins, and a fact meets only
    the intervals of its own bin. Where some key has far more than others, no width of bins fits, and
    the facts look up by ``last_known``.
    """
    s = spans.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in spans.columns])
    n, low, high = s.agg(F.count(F.lit(1)), F.min(at), F.max(at)).first()
    if n <= broadcast_rows:
        s, x, cond = F.broadcast(s), facts, F.lit(True)
    else:
        n_keys, most = s.groupBy(*[f"__{k}" for k in keys]).count().agg(F.count(F.lit(1)), F.max("count")).first()
        if most * n_keys > UNEVEN * n:
            found = last_known(facts, spans, keys, ts, at, [c for c in spans.columns if c not in keys])
            inside = F.col(ts) < F.col(end)
            return found.withColumns({c: F.when(inside, F.col(c)) for c in spans.columns if c not in keys})
        bins = max(1, n // n_keys)
        width = (high - low) // bins + 1
        place = lambda c: F.floor((c - F.lit(low)) / F.lit(width)).cast("long")
        s = s.withColumn("__bin", F.explode(F.sequence(place(F.col(at)), place(F.least(F.col(end), F.lit(high))))))
        x = facts.withColumn("__own_bin", place(F.least(F.col(ts), F.lit(high))))
        cond = F.col("__own_bin") == F.col("__bin")
    cond = cond & (F.col(ts) >= s[at]) & (F.col(ts) < s[end])
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    return x.join(s, cond, "left").drop("__bin", "__own_bin", *[f"__{k}" for k in keys])


def _fill(keys: list[str], values: list[str]):
    """A task's rows in order of key and time: facts (kind 1) take the values of the last log row (kind 0) of their key.

    Facts before the first log row of the task's first key stay open, as that key may have begun in a
    task before; the task's last log row goes out as its tail (kind 2).
    """

    def shape(batch: pa.RecordBatch) -> pa.Schema:
        """All batches go out alike: any column may be null."""
        return pa.schema([pa.field(f.name, f.type) for f in batch.schema] + [pa.field("__open", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first = None
        for batch in parts:
            if not batch.num_rows:
                continue
            first = first or [batch.column(k)[0] for k in keys]
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            n = rows.num_rows
            begins = np.zeros(n, bool)
            begins[0] = True
            for k in keys:
                c = rows.column(k)
                begins[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            log = rows.column("__kind").to_numpy() == 0
            place = np.arange(n)
            start = np.maximum.accumulate(np.where(begins, place, 0))
            last = np.maximum.accumulate(np.where(log, place, -1))
            known = last >= start
            at = pa.array(np.where(known, last, 0), mask=~known)
            opening = ~known
            for k, v in zip(keys, first):
                opening &= pc.fill_null(pc.equal(rows.column(k), v), False).to_numpy(zero_copy_only=False)
            filled = rows
            for v in values:
                filled = filled.set_column(filled.schema.get_field_index(v), filled.schema.field(v), rows.column(v).take(at))
            filled = filled.append_column("__open", pa.array(opening)).filter(pa.array(~log))
            yield from filled.cast(shape(batch)).to_batches()
            if log.any():
                held = rows.slice(int(last[-1]), 1).to_batches()[0]
        if held is not None:
            tail = held.set_column(held.schema.get_field_index("__kind"), "__kind", pa.array([2], pa.int32()))
            yield from pa.Table.from_batches([tail.append_column("__open", pa.array([False]))]).cast(shape(held)).to_batches()

    return run


def last_known(facts: DataFrame, log: DataFrame, keys: list[str], ts: str, at: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """``facts`` with ``columns`` of the key's newest log row up to ``ts``; no join, and no key in one task.

    Facts and log are dealt together by ranges of (key, time), so a busy key fills several tasks and
    all are alike in size. Each task carries the last log row forward; what a key brings from one
    task into the next is a row a task, which are chained and then handed to the facts left open. The
    rows are written once between the two. Keys may be null and then have no log.
    """
    spark = facts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*facts.schema.fields, *[T.StructField(c, log.schema[c].dataType) for c in columns]])
    none = lambda c: F.lit(None).cast(schema[c].dataType).alias(c)
    mine = facts.select(*facts.columns, *map(none, columns), F.lit(1).alias("__kind"), F.col(ts).alias("__t"), F.monotonically_increasing_id().alias("__salt"))
    keyed = log.select(*[F.col(k).cast(schema[k].dataType).alias(k) for k in keys], F.col(at).alias("__at"), *[F.col(c).alias(f"__v_{c}") for c in columns])
    named = keyed.select(*[F.col(c) if c in keys else none(c) for c in facts.columns], *[F.col(f"__v_{c}").alias(c) for c in columns], F.lit(0).alias("__kind"), F.col("__at").alias("__t"), F.lit(-1).cast("long").alias("__salt"))
    order = [*keys, "__t", "__kind", "__salt"]
    dealt = mine.unionByName(named.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(*order)
    out = T.StructType([*dealt.schema.fields, T.StructField("__open", T.BooleanType())])
    rows = written(dealt.mapInArrow(_fill(keys, columns), out), "last-known")
    value = F.struct(*[F.col(c) for c in columns])
    ends = rows.where("__kind = 2").select(*keys, "__part", value.alias("v"), F.lit(True).alias("tail"))
    asks = rows.where("__open").select(*keys, "__part").distinct().withColumns({"v": F.lit(None).cast(ends.schema["v"].dataType), "tail": F.lit(False)})
    before = Window.partitionBy(*keys).orderBy("__part", "tail").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.unionByName(asks).withColumn("v", F.last("v", ignorenulls=True).over(before)).where("NOT tail").select(F.col("__part").alias("__from"), F.col("v").alias("__v"))
    found = rows.where("__kind = 1").join(F.broadcast(brought), F.col("__open") & (F.col("__part") == F.col("__from")), "left")  # a row a task
    return found.select(*facts.columns, *[F.coalesce(F.col(c), F.col(f"__v.{c}")).alias(c) for c in columns])


def carried_forward(log: DataFrame, keys: list[str], columns: list[str], at: str) -> DataFrame:
    """Nulls take the last value read within the key."""
    upto = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})


def calendar_asof(rates: DataFrame, date: str, value: str, first: str, last: str, horizon: int) -> DataFrame:
    """A row a day with the newest value at most ``horizon`` days back, its date, and whether it is an estimate.

    Values that aren't positive count as no observation. A looked-back value is estimated from the
    newest known date on.
    """
    seen = rates.where(F.col(value) > 0).select(F.to_date(date).alias("seen"), F.col(value).alias("v"))
    days = rates.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("d"))
    # each observation serves the days up to its horizon; a day takes the newest one
    serves = seen.select("seen", "v", F.explode(F.sequence("seen", F.date_add("seen", horizon))).alias("d"))
    best = serves.groupBy("d").agg(F.max(F.struct("seen", "v")).alias("s"))
    newest = seen.agg(F.max("seen").alias("newest"))
    out = days.join(best, "d", "left").crossJoin(F.broadcast(newest))
    return out.select(
        F.date_format("d", "yyyy-MM-dd").alias("date"), F.col("s.v").alias("rate"), F.date_format("s.seen", "yyyy-MM-dd").alias("rate_date"),
        ((F.col("s.seen") < F.col("d")) & (F.col("d") >= F.col("newest"))).alias("estimated"),
    )


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
