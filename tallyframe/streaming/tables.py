"""Streams that keep tables: logs in pieces, minute partials, and snapshots that a loss holds back.

Each batch writes one folder, ``epoch=E``, which a second attempt at it replaces; nothing else is
written, so a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.maintenance import fell
from ..sources import logs


class Epochs:
    """A table whose rows come by epoch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])

    def put(self, df: DataFrame, epoch: int, *by: str) -> None:
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields[:-1]]).write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/epoch={epoch}")

    def read(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)


# -- logs in pieces --------------------------------------------------------------------------------

FOLDERS = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("cwd", T.StringType())])


class LogTable:
    """The calls of logs that arrive piece by piece.

    A log's calls take the folder that its first line with one names, which may come pieces after
    them. So calls are stored as they come, the first folder of each log is kept in a table of its
    own, and both meet at read: a folder that comes late gives all calls of its log their project.
    """

    def __init__(self, spark: SparkSession, path: str, roots: tuple[str, ...] = ()):
        self.spark, self.roots = spark, roots
        self.calls = Epochs(spark, f"{path}/calls", logs.CALLS)
        self.folders = Epochs(spark, f"{path}/folders", FOLDERS)

    def put(self, lines: DataFrame, epoch: int) -> None:
        """``lines`` (value, file_path, place): a batch; ``place`` rises with the lines of a log within it."""
        known = self.folders.read().where(F.col("epoch") < epoch).select("file_path").distinct()
        self.folders.put(logs.first_folders(lines).join(known, "file_path", "left_anti"), epoch)
        self.calls.put(logs.log_calls(lines), epoch)

    def read(self, remotes: DataFrame | None = None) -> DataFrame:
        # of a folder that a restarted stream found twice the earliest counts
        first = self.folders.read().groupBy("file_path").agg(F.min_by("cwd", "epoch").alias("cwd"))
        return logs.with_projects(self.calls.read().drop("epoch"), first, self.roots, remotes)


def follow_logs(spark: SparkSession, root: str, table: LogTable, checkpoint: str, log_name, pattern: str = "*.jsonl", files_per_batch: int = 1000):
    """A query that stores new pieces below ``root``; ``log_name`` makes the log's name of a piece's path. Pieces of one batch go in order of their paths."""
    raw = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).text(root)
    m = F.col("_metadata")
    raw = raw.select("value", m["file_path"].alias("piece"), m["file_block_start"].alias("block"))

    def put(batch: DataFrame, epoch: int) -> None:
        place = F.struct("piece", "block", F.monotonically_increasing_id().alias("row"))
        table.put(batch.select("value", log_name(F.col("piece")).alias("file_path"), place.alias("place")), epoch)

    return raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)


# -- minute partials ---------------------------------------------------------------------------------

MINUTE = 60_000_000
PARTIAL = T.StructType([T.StructField("minute_us", T.LongType()), T.StructField("machine_id", T.StringType()), T.StructField("target", T.StringType()), T.StructField("cost", T.DecimalType(30, 10)), T.StructField("n", T.LongType())])


def minute_partials(calls: DataFrame) -> DataFrame:
    """(minute_us, machine_id, target, cost, n) of calls, by the cost rule of cost windows: partials of any batches add up."""
    cost = F.coalesce(F.nullif(F.col("log_cost"), F.lit(0)), "computed")
    minute = (F.floor(F.col("ts_us") / MINUTE) * MINUTE).cast("long").alias("minute_us")
    return calls.groupBy(minute, "machine_id", "target").agg(F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("n"))


def follow_minutes(calls: DataFrame, table: Epochs, checkpoint: str):
    return calls.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: table.put(minute_partials(batch), epoch))


def rolling_windows(partials: DataFrame, nows: list[int], hours: tuple[int, ...], scope: str) -> DataFrame:
    """(now_us, win, cost, project_cost) at each of ``nows`` (whole minutes): sums of the minutes up to it, one pass over the partials and none over calls."""
    zero = F.lit(0).cast("decimal(38,10)")
    sums, rows = [], []
    for k, now in enumerate(nows):
        for h in (*hours, None):
            inside = (F.col("minute_us") < now) & (F.lit(True) if h is None else F.col("minute_us") >= now - h * 60 * MINUTE)
            name, win = f"{k}_{h}", "all" if h is None else f"{h}h"
            sums += [F.coalesce(F.sum(F.when(c, F.col("cost"))), zero).alias(f"{p}{name}") for p, c in (("a", inside), ("p", inside & F.coalesce(F.col("target") == scope, F.lit(False))))]
            rows.append(F.struct(F.lit(now).cast("long").alias("now_us"), F.lit(win).alias("win"), F.col(f"a{name}").alias("cost"), F.col(f"p{name}").alias("project_cost")))
    return partials.agg(*sums).select(F.inline(F.array(*rows)))


# -- snapshots ---------------------------------------------------------------------------------------

REPORT = T.StructType([T.StructField(c, T.LongType()) for c in ("n_rows", "n_costs", "old_rows", "old_costs")] + [T.StructField("refused", T.BooleanType())])


class Snapshots:
    """Snapshots by epoch, each with a report. One that has lost a tenth of its rows or costs against the last good one is refused: it stays aside, and ``read`` gives the one before."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, cost: str = "log_cost"):
        self.data, self.report, self.cost = Epochs(spark, f"{path}/data", schema), Epochs(spark, f"{path}/report", REPORT), cost

    def put(self, batch: DataFrame, epoch: int) -> bool:
        """Whether it was taken. Its rows are counted while they are written."""
        counts = Observation()
        self.data.put(batch.observe(counts, F.count(F.lit(1)).alias("n_rows"), F.count(self.cost).alias("n_costs")), epoch)
        new = counts.get
        good = self.report.read().where((F.col("epoch") < epoch) & ~F.col("refused")).orderBy(F.desc("epoch")).first()
        old = (good["n_rows"], good["n_costs"]) if good else (None, None)
        refused = any(fell(a, b) for a, b in zip(old, (new["n_rows"], new["n_costs"])))
        self.report.put(batch.sparkSession.createDataFrame([(new["n_rows"], new["n_costs"], *old, refused)], REPORT), epoch)
        return not refused

    def read(self) -> DataFrame:
        """The last good snapshot."""
        good = self.report.read().where("NOT refused").agg(F.max("epoch")).first()[0]
        return self.data.read().where(F.col("epoch") == (-1 if good is None else good)).drop("epoch")


def follow_snapshots(stream: DataFrame, table: Snapshots, checkpoint: str):
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: table.put(batch, epoch) and None)
