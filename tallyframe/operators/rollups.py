"""A rollup that is kept beside the stamps of all it was made from, and made anew only where those moved.

Below one folder lie ``rows/version=V/day=D`` and ``stamps/version=V``, written last: a row for each
day with the stamp of its calls and the version that holds its rows, and a row for each other input
(prices, logins, rules). A refresh stamps the inputs again. If another input moved, every day is made
anew; else the days whose calls moved, a late file's days among them, also those on which it changed
a verdict. Nothing committed is written again, so a refresh that breaks off leaves the version before
it, and readers see one version as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .maintenance import content_stamp

STAMPS = "name string, day string, n long, stamp string, version_of_rows long, version long"


class StampedRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _stamps(self) -> DataFrame:
        """Those of the newest version; empty before the first."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/stamps")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], STAMPS)
        every = self.spark.read.schema(STAMPS).parquet(f"{self.path}/stamps")
        newest = every.agg(F.max("version")).first()[0]
        return every.where(F.col("version") == newest)

    def refresh(self, calls: DataFrame, inputs: dict[str, DataFrame], fold: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Brings the rollup up to ``calls`` (with ``day`` and what ``fold`` reads) and the other inputs; the days made anew.

        ``fold`` gives rows with ``day`` from the calls of whole days. Stamps are sums of hashes, so
        they are worked out task by task without moving calls.
        """
        old = self._stamps()
        held = {(r["name"], r["day"]): r for r in old.collect()}  # a row a day
        version = max((r["version"] for r in held.values()), default=-1) + 1
        now: dict[tuple, tuple] = {}
        for name, df in inputs.items():
            s = content_stamp(df, sorted(df.columns)).first()
            now[name, None] = s["n"], s["stamp"]
        columns = sorted(c for c in calls.columns if c != "day")
        each = calls.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string").alias("stamp"))
        now |= {("calls", r["day"]): (r["n"], r["stamp"]) for r in each.collect()}
        same = lambda key: key in held and (held[key]["n"], held[key]["stamp"]) == now[key]
        others = {k for k in held if k[0] != "calls"} == {k for k in now if k[0] != "calls"} and all(same(k) for k in now if k[0] != "calls")
        moved = sorted((k[1] for k in now if k[0] == "calls" and not (others and same(k))), key=str)
        gone = [k for k in held if k[0] == "calls" and k not in now]
        if held and others and not moved and not gone:
            return []
        if moved:
            whole = calls if len(moved) == sum(k[0] == "calls" for k in now) else calls.where(F.col("day").isin(*[d for d in moved if d is not None]) | (F.lit(None in moved) & F.col("day").isNull()))
            fold(whole).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/rows/version={version}")
        rows = [(*k, *v, version if k[0] != "calls" or k[1] in moved else held[k]["version_of_rows"]) for k, v in now.items()]
        self.spark.createDataFrame(rows, "name string, day string, n long, stamp string, version_of_rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stamps/version={version}")
        return moved

    def read(self) -> DataFrame:
        """The folded rows of all days, each from the version that made it."""
        days = self._stamps().where("name = 'calls'").select(F.col("day").alias("__day"), "version_of_rows")
        rows = self.spark.read.option("mergeSchema", False).parquet(f"{self.path}/rows")
        rows = rows.withColumn("day", F.date_format("day", "yyyy-MM-dd") if rows.schema["day"].dataType.typeName() == "date" else F.col("day"))
        met = rows.join(F.broadcast(days), F.col("day").eqNullSafe(F.col("__day")) & (F.col("version") == F.col("version_of_rows")))  # a row a day
        return met.drop("__day", "version_of_rows", "version")
