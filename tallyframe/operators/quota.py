"""Rate-limit windows: samples, the window instances they add up to, and what their rise cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import ratio
from .asof import small

FARTHEST_S = 8 * 86_400
PARTIAL_PP = 5.0


def seconds(ts: Column | str = "ts_us") -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts) / F.lit(1_000_000.0)


def reset_minute(resets: str = "resets_at") -> Column:
    """The whole minute, halves to even: samples of one window jitter around it."""
    return (F.rint(F.col(resets) / 60) * 60).cast("long")


def is_placeholder() -> Column:
    return F.col("resets_at") - seconds() > FARTHEST_S


def admitted() -> Column:
    return F.col("used_pct").isNotNull() & F.col("resets_at").isNotNull() & (F.col("resets_at") > seconds()) & (F.col("resets_at") - seconds() <= FARTHEST_S)


def adjust_passed(samples: DataFrame, now_us: int) -> DataFrame:
    """A reset that has passed leaves nothing used and no reset."""
    passed = F.col("resets_at") <= now_us / 1e6
    return samples.withColumns({"used_pct": F.when(passed, 0.0).otherwise(F.col("used_pct")), "resets_at": F.when(~passed, F.col("resets_at"))})


def window_start(resets: Column, span_s: Column, now_us: int) -> Column:
    return F.when(resets <= now_us / 1e6, resets).otherwise(resets - span_s)


def window_instances(samples: DataFrame, spans: DataFrame, now_us: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per (keys, window, model, reset minute) with its measures, from one aggregate.

    The peak time is the first at which the peak was read. Rate and projection are null where
    the window never rose or no time passed.
    """
    kept = samples.where(~is_placeholder()).withColumn("reset_min", reset_minute())
    by = kept.groupBy(*keys, "win", "model", "reset_min").agg(
        F.max("used_pct").alias("peak"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.min(F.struct((-F.col("used_pct")).alias("p"), "ts_us"))["ts_us"].alias("peak_us"),
        F.min_by("used_pct", F.struct("ts_us", "event_id")).alias("opening"),
        F.max_by("used_pct", F.struct("ts_us", "event_id")).alias("latest"),
        F.count(F.lit(1)).alias("n_samples"),
    )
    own = by.join(small(spans.select("win", "ord", "span_s", "family")), "win", "left")
    rise = F.col("peak") - F.col("opening")
    fill = seconds("peak_us") - seconds("first_us")
    start = F.col("reset_min") - F.col("span_s")
    return own.withColumns({
        "rise": rise, "fill_s": F.round(fill, 6), "hit": F.rint("peak") >= 100,
        "pp_per_hour": F.when((rise > 0) & (fill > 0), F.round(rise / fill * 3600, 6)),
        "unseen_s": F.round(F.greatest(seconds("first_us") - start, F.lit(0.0)), 6),
        "partial": F.col("opening") >= PARTIAL_PP,
        "open": F.col("reset_min") > now_us / 1e6,
    })


def projection(instances: DataFrame) -> DataFrame:
    """Percent at the reset if the pace from the window's start to its last sample holds; not capped."""
    start = F.col("reset_min") - F.col("span_s")
    gone = seconds("last_us") - start
    return instances.withColumn("projected", F.when(gone > 0, F.round(F.col("latest") / gone * F.col("span_s"), 6)))


def latest_readings(samples: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    newest = F.max_by(F.struct("used_pct", "resets_at", "ts_us", "source"), F.struct("ts_us", "event_id")).alias("r")
    return samples.groupBy(*keys).agg(newest).select(*keys, "r.*")


def span_spend(instances: DataFrame, calls: DataFrame, key: str = "account_uuid", bin_us: int = 21_600_000_000) -> DataFrame:
    """Instances with the calls of their account (and family) from first sample to peak, both included.

    Spans overlap and no single order serves them all, so they are laid over bins of time:
    (account, bin) is the join key and the exact bounds are checked behind it. A call meets only
    the spans over its bin, and a busy account spreads over its bins.
    """
    spans = instances.select(
        key, "win", "model", "reset_min", "first_us", "peak_us", "family", F.explode(F.sequence(F.floor(F.col("first_us") / bin_us), F.floor(F.col("peak_us") / bin_us))).alias("bin")
    )
    c = calls.select(F.col(key).alias("k"), F.floor(F.col("ts_us") / bin_us).alias("b"), F.col("ts_us").alias("at"), F.col("family").alias("f"), "cost", "cache_read", "observed")
    inside = (spans[key] == c["k"]) & (spans["bin"] == c["b"]) & (c["at"] >= spans["first_us"]) & (c["at"] <= spans["peak_us"])
    met = spans.join(c, inside & (spans["family"].isNull() | (spans["family"] == c["f"])))
    return met.groupBy(key, "win", "model", "reset_min").agg(
        F.sum("cost").alias("spend"), F.sum("cache_read").alias("cache_read"), F.sum("observed").alias("observed"), F.count(F.lit(1)).alias("n_calls")
    )


def priced_instances(instances: DataFrame, calls: DataFrame, key: str = "account_uuid") -> DataFrame:
    """Instances with what their rise cost: spend, reads, input and calls, spend a percent, and what is left of an open one at that price.

    All are null where the window never rose while it was watched, and 0 where it rose without a
    call. Past 100 percent nothing is left.
    """
    keys = [key, "win", "model", "reset_min"]
    rose = F.col("rise") > 0
    s = span_spend(instances.where(rose), calls, key).select(*[F.col(k).alias(f"__{k}") for k in keys], "spend", "cache_read", "observed", "n_calls")
    x = instances.join(s, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])
    x = x.withColumns({c: F.when(rose, F.coalesce(c, F.lit(0).cast(x.schema[c].dataType))) for c in ("spend", "cache_read", "observed", "n_calls")})
    per = F.col("spend").cast("double") / F.nullif(F.col("rise"), F.lit(0.0))
    return x.withColumn("per_pp", per).withColumn("headroom", F.when(F.col("open"), F.greatest(100 - F.col("latest"), F.lit(0.0)) * F.col("per_pp")))


def window_family(model_family: Column) -> Column:
    """The sample's own model decides, else the window type's fixed family; null stands for all."""
    return F.when(F.col("model").isNotNull(), model_family).otherwise(F.col("family"))


def extra_increments(readings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Cents added at each reading; a drop is a new month, whose whole reading counts; the first has none."""
    before = F.lag("spent_cents").over(Window.partitionBy(*keys).orderBy("ts_us", "event_id"))
    step = F.when(before.isNull(), F.lit(None)).when(F.col("spent_cents") < before, F.col("spent_cents")).otherwise(F.col("spent_cents") - before)
    return readings.withColumn("added", step.cast("long"))


# Seconds up to which a reading counts as fresh, by where it came from.
FRESH = {"stdin": 900, "api": 3600}


def verdicts(samples: DataFrame, accounts: DataFrame, plans: DataFrame, windows: list[str], warn: float | None, stop: float) -> DataFrame:
    """(account_uuid, pct, verdict) for every row (account_uuid, now_us) of ``accounts``.

    A window's percent is the highest of its sources' newest readings that are fresh, 0 once the
    reset has passed. Without a fresh one it is left out where ``plans`` (account_uuid, win,
    applicable) says that the plan lacks it, and unknown where there are readings or the plan has it.
    No window at all stops; then stop, unknown, warn, ok, in this order.
    """
    newest = F.max_by(F.struct("used_pct", "resets_at", "ts_us"), F.struct("ts_us", "event_id")).alias("r")
    read = samples.join(accounts, "account_uuid").where(F.col("ts_us") <= F.col("now_us"))
    each = read.groupBy("account_uuid", "win", "source").agg(newest, F.first("now_us").alias("now_us"))
    budget = F.when(F.col("source") == "stdin", FRESH["stdin"]).otherwise(FRESH["api"]).cast("long") * 1_000_000
    pct = F.when(F.col("r.resets_at") <= F.col("now_us") / 1e6, 0.0).otherwise(F.col("r.used_pct"))
    seen = each.groupBy("account_uuid", "win").agg(F.max(F.when(F.col("now_us") - F.col("r.ts_us") <= budget, pct)).alias("pct"), F.lit(True).alias("read"))
    every = accounts.select("account_uuid", F.explode(F.array(*map(F.lit, windows))).alias("win"))
    x = every.join(seen, ["account_uuid", "win"], "left").join(plans, ["account_uuid", "win"], "left")
    absent = F.col("pct").isNull() & (F.coalesce(~F.col("applicable"), F.lit(False)) | F.col("read").isNull() & ~F.coalesce("applicable", F.lit(False)))
    top, known = F.max("pct"), F.count_if(~absent)
    word = F.when((known == 0) | (top >= stop), "stop").when(F.count_if(~absent & F.col("pct").isNull()) > 0, "unknown")
    if warn is not None:
        word = word.when(top >= warn, "warn")
    return x.groupBy("account_uuid").agg(top.alias("pct"), word.otherwise("ok").alias("verdict"))


def extra_spans(instances: DataFrame, readings: DataFrame, now_us: int, key: str = "account_uuid", bin_us: int = 21_600_000_000) -> DataFrame:
    """(key, win, model, reset_min, machine_id, added, n_inside) for each instance and machine that read inside it, and one row with nulls for an instance without.

    An instance runs from its start, its first sample where that isn't known, to its reset or now.
    ``added`` is what came on top of the last reading up to the start; without one the series must
    begin inside at 0, else nothing bounds the span and it is null, as it is without a further reading.
    """
    start = F.coalesce((F.col("reset_min") - F.col("span_s")) * 1_000_000, F.col("first_us")).cast("long")
    w = instances.select(key, "win", "model", "reset_min", start.alias("a_us"), F.least(F.col("reset_min") * 1_000_000, F.lit(now_us)).cast("long").alias("z_us"))
    bins = F.when(F.col("z_us") >= F.col("a_us"), F.sequence(F.floor(F.col("a_us") / bin_us), F.floor(F.col("z_us") / bin_us)))
    spans = w.withColumn("bin", F.explode_outer(bins))
    e = extra_increments(readings, (key, "machine_id")).select(
        F.col(key).alias("k"), F.floor(F.col("ts_us") / bin_us).alias("b"), F.col("ts_us").alias("at"), "machine_id", "added", "spent_cents"
    )
    met = spans.join(e, (spans[key] == e["k"]) & (spans["bin"] == e["b"]) & (e["at"] >= spans["a_us"]) & (e["at"] <= spans["z_us"]))
    later = F.col("at") > F.col("a_us")
    keys = [key, "win", "model", "reset_min"]
    per = met.groupBy(*keys, "machine_id").agg(
        F.sum(F.when(later, F.col("added"))).alias("sum"), F.max(F.when(later & F.col("added").isNull(), F.col("spent_cents"))).alias("opening"), F.count(F.lit(1)).alias("n_inside")
    ).select(*[F.col(c).alias(f"__{c}") for c in keys], "machine_id", F.when(F.coalesce("opening", F.lit(0)) == 0, F.col("sum")).alias("added"), "n_inside")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return w.join(per, same, "left").select(*keys, "machine_id", "added", F.coalesce("n_inside", F.lit(0)).cast("long").alias("n_inside"))


def closest_series(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Of each instance the machine that read it most, among those that can answer; the lower name on a tie; nulls where none can."""
    answers = F.when(F.col("added").isNotNull(), F.struct(-F.col("n_inside"), "machine_id", "added"))
    best = spans.groupBy(*keys).agg(F.min(answers).alias("best"))
    return best.select(*keys, F.col("best.machine_id").alias("machine_id"), F.col("best.added").alias("added"))


def group_summary(priced: DataFrame) -> DataFrame:
    """Per window type: hits, highest peak, spend, spend over rise, reads over input, Extra (``added``)."""
    return priced.groupBy("win").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"), F.max("peak").alias("max_peak"), F.sum("spend").alias("spend"),
        ratio(F.sum("spend"), F.sum(F.when(F.col("spend").isNotNull(), F.col("rise")))).alias("usd_per_pp"),
        ratio(F.sum("cache_read"), F.sum("observed")).alias("cache_hit"), F.sum("added").alias("extra_cents"),
    )
