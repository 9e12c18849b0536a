"""Session logs and API payloads in, exports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import project_name

LINE = """type string, timestamp string, sessionId string, cwd string, requestId string, costUSD string,
 message struct<id:string, model:string, usage:struct<input_tokens:bigint, output_tokens:bigint, cache_creation_input_tokens:bigint, cache_read_input_tokens:bigint>>"""
COUNTS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
QUOTA = """five_hour struct<utilization:double, resets_at:string>, seven_day struct<utilization:double, resets_at:string>, seven_day_sonnet struct<utilization:double, resets_at:string>,
 limits array<struct<kind:string, percent:double, resets_at:string, scope:struct<model:struct<display_name:string>>>>,
 extra_usage struct<utilization:double, used_credits:double, monthly_limit:double>"""


def inventory(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """(file_path, mtime_us, size) of every log below the root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.col("path").alias("file_path"), F.unix_micros("modificationTime").alias("mtime_us"), F.col("length").alias("size"))


def read_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """(value, file_path, place) of every line below the root; ``place`` rises with the lines of a file."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select("value", F.col("_metadata.file_path").alias("file_path"), place.alias("place"))


def _read(lines: DataFrame) -> DataFrame:
    return lines.withColumn("j", F.from_json("value", LINE)).where(F.col("j").isNotNull())


def first_folders(lines: DataFrame) -> DataFrame:
    """(file_path, cwd): the first folder that any line of a log names."""
    named = _read(lines).where(F.coalesce(F.col("j.cwd"), F.lit("")) != "")
    return named.groupBy("file_path").agg(F.min_by("j.cwd", "place").alias("cwd"))


def log_calls(lines: DataFrame) -> DataFrame:
    """Calls of logs, without their project: bad and other lines and empty usages are passed over, absent counts are 0, a time without zone is UTC."""
    stem = F.regexp_replace(F.regexp_extract("file_path", "([^/]+)$", 1), "\\.jsonl$", "")
    filled = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), other)
    u = "j.message.usage."
    time, day = F.trim("j.timestamp"), "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    zone = F.when(time.rlike(day + "$"), "T00:00:00Z").when(time.rlike("(?i)(z|[+-][0-9]{2}:?[0-9]{2})$"), "").otherwise("Z")
    x = _read(lines).withColumn("ts", F.when(time.rlike(day), F.try_to_timestamp(F.concat(time, zone))))
    # a usage without any of the four counts may still hold something else
    used = F.coalesce(*(F.col(f"j.message.usage.{c}") for c in COUNTS)).isNotNull() | (F.get_json_object("value", "$.message.usage") != "{}")
    calls = x.where((F.col("j.type") == "assistant") & F.col("j.message.usage").isNotNull() & used & F.col("ts").isNotNull())
    count = lambda c: F.coalesce(F.col(u + c), F.lit(0))
    return calls.select(
        "file_path", F.unix_micros("ts").alias("ts_us"), filled("j.sessionId", stem).alias("sid"), F.col("j.message.id").alias("mid"),
        filled("j.message.model", F.lit("unknown")).alias("model"),
        F.when((F.col("j.message.id") != "") & (F.col("j.requestId") != ""), F.concat("j.message.id", F.lit(":"), "j.requestId")).alias("dk"),
        F.expr("try_cast(j.costUSD AS decimal(30,10))").alias("log_cost"), count("input_tokens").alias("input_tokens"), count("output_tokens").alias("output_tokens"),
        count("cache_creation_input_tokens").alias("cache_create"), count("cache_read_input_tokens").alias("cache_read"),
    )


CALLS = T.StructType(
    [T.StructField(c, k) for c, k in (("file_path", T.StringType()), ("ts_us", T.LongType()), *((c, T.StringType()) for c in ("sid", "mid", "model", "dk")), ("log_cost", T.DecimalType(30, 10)))]
    + [T.StructField(c, T.LongType()) for c in ("input_tokens", "output_tokens", "cache_create", "cache_read")]
)


def with_projects(calls: DataFrame, folders: DataFrame, roots: tuple[str, ...] = (), remotes: DataFrame | None = None) -> DataFrame:
    """Calls with ``cwd``, ``repo`` and ``project`` of their log.

    The folder gives the project: the remote's name where ``remotes`` (cwd, repo) knows the folder, the
    name below the deepest of ``roots``, else the folder's own; without a folder, that of the file.
    """
    if remotes is None:
        folders = folders.withColumn("repo", F.lit(None).cast("string"))
    else:
        folders = folders.join(remotes.select("cwd", "repo"), "cwd", "left")
    own = F.regexp_extract("file_path", "([^/]+)/[^/]+$", 1)
    return calls.join(folders, "file_path", "left").withColumn("project", project_name(F.col("repo"), F.col("cwd"), roots, own))


def parse_lines(lines: DataFrame, roots: tuple[str, ...] = (), remotes: DataFrame | None = None) -> DataFrame:
    """The calls of whole logs with their projects."""
    return with_projects(log_calls(lines), first_folders(lines), roots, remotes)


def parse_quota(bodies: DataFrame) -> DataFrame:
    """The twelve quota columns of a response body: whole percents, resets, the first scoped limit that has a percent and names a model, dollars; an absent quota is null."""
    x = bodies.withColumn("j", F.from_json("body", QUOTA))
    named = lambda v: v["scope"]["model"]["display_name"]
    scoped = F.get(F.filter("j.limits", lambda v: (v["kind"] == "weekly_scoped") & v["percent"].isNotNull() & (F.coalesce(named(v), F.lit("")) != "")), 0)
    pct = lambda c: c.cast("int")
    at = lambda c: F.when(c != "", c)
    whole = [
        c for name, field in (("session", "five_hour"), ("week", "seven_day"), ("sonnet", "seven_day_sonnet"))
        for c in (pct(F.col(f"j.{field}.utilization")).alias(f"{name}_percent"), at(F.col(f"j.{field}.resets_at")).alias(f"{name}_reset"))
    ]
    e = "j.extra_usage."
    return x.select(
        *[c for c in bodies.columns if c != "body"], *whole, pct(scoped["percent"]).alias("scoped_percent"), named(scoped).alias("scoped_model"), at(scoped["resets_at"]).alias("scoped_reset"),
        pct(F.col(e + "utilization")).alias("extra_percent"), (F.col(e + "used_credits") / 100).alias("extra_spent"), (F.col(e + "monthly_limit") / 100).alias("extra_limit"),
    )


def clean_rates(rates: DataFrame, low: float = 5, high: float = 20) -> tuple[DataFrame, DataFrame]:
    """(plausible, rejected)."""
    good = F.col("rate").between(low, high)
    return rates.where(good), rates.where(~good)
