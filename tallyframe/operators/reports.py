"""Reports: buckets by a key, breakdowns, splits, totals, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import KINDS, ratio, usd
from ..functions.names import is_pseudo, model_family, short_model
from .stored import written

MEASURES = (*KINDS, "tokens", "cost", "n_calls")


def bucket(calls: DataFrame, *keys: Column | str) -> DataFrame:
    """Sums of all measures by key: one partial and one final aggregate."""
    return calls.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MEASURES])


def shown(buckets: DataFrame, *keys: str) -> DataFrame:
    """Keys, then measures with the cost in dollars."""
    return buckets.select(*keys, *KINDS, "tokens", usd(F.col("cost")).alias("cost"), "n_calls")


def with_models(calls: DataFrame, *keys: str) -> DataFrame:
    """Buckets with a map model -> cost, from a two-level aggregate; ``<synthetic>`` counts but isn't named."""
    each = calls.groupBy(*keys, "model").agg(*[F.sum(m).alias(m) for m in MEASURES])
    named = F.when(F.col("model") != "<synthetic>", F.struct("model", usd(F.col("cost")).alias("cost")))
    return each.groupBy(*keys).agg(
        *[F.sum(m).alias(m) for m in MEASURES], F.map_from_entries(F.sort_array(F.collect_list(named))).alias("models")
    )


def breakdown(calls: DataFrame, key: str) -> DataFrame:
    """Key x model, priciest first within the key, names breaking ties."""
    each = bucket(calls, key, short_model(F.col("model")).alias("short"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cost"), "short"))
    return each.withColumn("rank", rank)


def ranked(calls: DataFrame, key: str, n: int) -> DataFrame:
    """The n costliest keys, with the shown and the overall totals beside each row and how many there are."""
    rows = written(bucket(calls, key), "ranked")  # read three times
    total = rows.agg(F.sum("cost").alias("all_cost"), F.count(F.lit(1)).alias("n_all"))
    top = rows.orderBy(F.desc("cost"), key).limit(n)
    part = top.agg(F.sum("cost").alias("shown_cost"))
    return top.crossJoin(F.broadcast(part)).crossJoin(F.broadcast(total))


def split_by(calls: DataFrame, key: str, by: str) -> DataFrame:
    """(key, by, cost): the rows of a report's split."""
    return calls.groupBy(key, by).agg(F.sum("cost").alias("cost"), F.sum("n_calls").alias("n_calls"))


def dimensions(calls: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, key, cost, tokens, n_calls, share) for every dimension, in one pass over the calls."""
    sets = calls.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(
        F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"), F.sum("n_calls").alias("n_calls"), F.grouping_id().alias("gid")
    )
    n = len(columns)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, c in enumerate(columns):
        own = F.col("gid") == ((1 << n) - 1 - (1 << (n - 1 - k)))
        name, value = F.when(own, F.lit(c)).otherwise(name), F.when(own, F.col(c)).otherwise(value)
    rows = sets.select(name.alias("dimension"), value.alias("key"), "cost", "tokens", "n_calls")
    whole = rows.groupBy("dimension").agg(F.sum("cost").alias("whole"))
    return rows.join(F.broadcast(whole), "dimension").select(
        "dimension", "key", usd(F.col("cost")).alias("cost"), "tokens", "n_calls", ratio(F.col("cost"), F.col("whole")).alias("share")
    )


def totals(buckets: DataFrame) -> DataFrame:
    """One row: the sum over buckets, their number, and the average bucket."""
    return buckets.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"), F.sum("n_calls").alias("n_calls")
    )


def top_with_other(calls: DataFrame, axis: str, trace: str, n: int = 6) -> DataFrame:
    """(axis, trace, cost): the n largest traces; the rest together as Other."""
    each = calls.groupBy(axis, trace).agg(F.sum("cost").alias("cost"))
    top = each.groupBy(trace).agg(F.sum("cost").alias("t")).orderBy(F.desc("t"), trace).limit(n).select(trace)
    marked = each.join(F.broadcast(top.withColumn("__top", F.lit(True))), trace, "left")
    return marked.withColumn(trace, F.when(F.col("__top"), F.col(trace)).otherwise("Other")).groupBy(axis, trace).agg(F.sum("cost").alias("cost"))


def visible_models(calls: DataFrame) -> DataFrame:
    return calls.where(~is_pseudo(F.col("model")))


def family_costs(calls: DataFrame, start_us: int, now_us: int) -> DataFrame:
    """(family, cost) of a window, by the cost rule of ``cost_windows``."""
    inside = calls.where((F.col("ts_us") >= start_us) & (F.col("ts_us") <= now_us))
    cost = F.coalesce(F.nullif(F.col("log_cost"), F.lit(0)), "computed")
    return inside.groupBy(model_family(F.col("model")).alias("family")).agg(F.sum(cost).alias("cost"))


def cost_windows(calls: DataFrame, starts: dict[str, int | None], now_us: int, session: str | None, scoped: tuple[str, ...]) -> DataFrame:
    """(win, cost, project_cost): all windows by conditional sums in one pass, then one row each.

    ``starts`` has each window's first microsecond, None for all time, 0 where it isn't known: such
    a window has no row. Those named in ``scoped`` also sum the calls of column ``scoped``.
    """
    cost, zero = F.coalesce(F.nullif(F.col("log_cost"), F.lit(0)), "computed"), F.lit(0).cast("decimal(38,10)")
    insides = {n: F.lit(True) if at is None else F.col("ts_us") >= at for n, at in starts.items() if at != 0}
    if session is not None:
        insides = {"session": F.col("sid") == session} | insides
    total = lambda inside: F.coalesce(F.sum(F.when(inside, cost)), zero)
    sums = [total(x).alias(f"a_{n}") for n, x in insides.items()] + [total(x & F.coalesce("scoped", F.lit(False))).alias(f"p_{n}") for n, x in insides.items() if n in scoped]
    row = lambda n: F.struct(F.lit(n).alias("win"), F.col(f"a_{n}").alias("cost"), (F.col(f"p_{n}") if n in scoped else F.lit(None).cast("decimal(38,10)")).alias("project_cost"))
    return calls.where(F.col("ts_us") <= now_us).agg(*sums).select(F.inline(F.array(*map(row, insides))))
