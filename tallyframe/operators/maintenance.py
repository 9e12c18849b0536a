"""Materialized aggregates and the checks around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import KINDS
from .asof import small
from .dedup import dedup_merged

ROLLUP_KEYS = ["day", "oslo_date", "sid", "project", "model", "account_uuid"]
ARCHIVE_KEYS = ["day", "sid", "project", "cwd", "repo", "model", "account_uuid", "file_path"]
SUMS = (*KINDS, "tokens", "cost", "n_calls")


def rollup(calls: DataFrame, keys: list[str] = ROLLUP_KEYS) -> DataFrame:
    """Calls folded by key: sums, the number of calls, first and last time."""
    return calls.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in SUMS], F.min("ts_us").alias("min_ts"), F.max("ts_us").alias("max_ts"))


def served(rolled: DataFrame, calls: DataFrame, cutoff_day: str) -> DataFrame:
    """Rolled-up days before the cutoff and single calls from it on, in one schema."""
    columns = [*ROLLUP_KEYS, *SUMS]
    return rolled.where(F.col("day") < cutoff_day).select(*columns).unionByName(calls.where(F.col("day") >= cutoff_day).select(*columns))


def archive_plan(records: DataFrame, gone: DataFrame, cutoff_us: int) -> DataFrame:
    """Why a purged file is held back from the archive, or ``fold``."""
    gone = small(gone)
    purged = records.join(gone, "file_path", "left_semi")
    live = records.join(gone, "file_path", "left_anti")
    per = purged.groupBy("file_path").agg(F.max("ts_us").alias("last_us"), F.count_distinct("account_uuid").alias("accounts"), F.count(F.lit(1)).alias("n"))
    shared = purged.where("dk <> ''").select("file_path", "dk").join(live.where("dk <> ''").select("dk").distinct(), "dk", "left_semi").select("file_path").distinct()
    x = per.join(shared.withColumn("collides", F.lit(True)), "file_path", "left")
    return x.withColumn("plan", F.when(F.col("last_us") >= cutoff_us, "newer").when(F.col("accounts") > 1, "account change").when(F.col("collides"), "live copy").otherwise("fold")).select("file_path", "n", "plan")


def anti_remainder(records: DataFrame, machine: str) -> DataFrame:
    """Other machines' calls that ``machine`` doesn't hold itself, then dedup; calls without a key are nobody's copies."""
    own = records.where((F.col("machine_id") == machine) & (F.col("dk") != "")).select("account_uuid", "dk").distinct()
    others = records.where(F.col("machine_id") != machine)
    return dedup_merged(others.join(own, ["account_uuid", "dk"], "left_anti"))


def _window_rows(hours: tuple[int, ...]) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(n).alias("win"), F.col(f"w_{n}").alias("cost")) for n in [*(f"{h}h" for h in hours), "all"]]))


def remainder_windows(rest: DataFrame, now_us: int, hours: tuple[int, ...]) -> DataFrame:
    """(machine_id, win, cost) for every window and machine, 0 where it spent nothing: minute buckets from each window's start on, all time from all days."""
    minute = (F.floor(F.col("ts_us") / 60_000_000) * 60_000_000).cast("long")
    zero = F.lit(0).cast("decimal(38,10)")
    kept = (F.col("ts_us") <= now_us) & (F.col("ts_us") > now_us - max(hours) * 3_600_000_000)  # buckets reach back as far as the longest window
    sums = [F.coalesce(F.sum(F.when(kept & (minute >= now_us - h * 3_600_000_000), F.col("cost"))), zero).alias(f"w_{h}h") for h in hours]
    return rest.groupBy("machine_id").agg(*sums, F.coalesce(F.sum("cost"), zero).alias("w_all")).select("machine_id", _window_rows(hours))


def own_windows(calls: DataFrame, now_us: int, hours: tuple[int, ...]) -> DataFrame:
    """(win, cost) of one machine's calls."""
    zero = F.lit(0).cast("decimal(38,10)")
    sums = [F.coalesce(F.sum(F.when(F.col("ts_us") >= now_us - h * 3_600_000_000, F.col("cost"))), zero).alias(f"w_{h}h") for h in hours]
    return calls.where(F.col("ts_us") <= now_us).agg(*sums, F.coalesce(F.sum("cost"), zero).alias("w_all")).select(_window_rows(hours))


def merged_windows(own: DataFrame, remote: DataFrame, pushed: DataFrame, now_us: int, stale_us: int = 3_600_000_000) -> DataFrame:
    """(win, cost, machines, oldest_us, stale): both halves together; as old as the contributor that pushed longest ago (``pushed``: machine_id, pushed_us)."""
    x = remote.join(small(pushed), "machine_id", "left").groupBy("win").agg(F.sum("cost").alias("rest"), F.count(F.lit(1)).alias("machines"), F.min("pushed_us").alias("oldest_us"))
    both = own.join(F.broadcast(x), "win", "left")  # a row a window
    stale = F.coalesce(F.lit(now_us) - F.col("oldest_us") > stale_us, F.lit(False))
    total = F.col("cost") + F.coalesce("rest", F.lit(0).cast("decimal(38,10)"))
    return both.select("win", total.alias("cost"), F.coalesce("machines", F.lit(0).cast("long")).alias("machines"), "oldest_us", stale.alias("stale"))


def content_stamp(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-free hash of the rows: a sum, in which repeated rows don't cancel out."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string").alias("stamp"))


def fell(old: int | None, new: int, share: float = 0.1, least: int = 100) -> bool:
    """Whether a count of at least ``least`` lost ``share`` or more."""
    return old is not None and old >= least and new <= old * (1 - share)


def drop_check(before: DataFrame, now: DataFrame, share: float = 0.1, least: int = 100) -> DataFrame:
    """Whether rows or priced rows fell by ``share`` or more against a snapshot of at least ``least``."""
    count = lambda d, p: d.agg(F.count(F.lit(1)).alias(f"{p}_rows"), F.count("log_cost").alias(f"{p}_costs"))
    x = count(before, "old").crossJoin(count(now, "new"))
    fell = lambda c: (F.col(f"old_{c}") >= least) & (F.col(f"new_{c}") <= F.col(f"old_{c}") * (1 - share))
    return x.withColumn("suspicious", fell("rows") | fell("costs"))
