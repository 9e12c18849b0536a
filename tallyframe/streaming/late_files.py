"""Files that come late, as a stream: each batch replaces whole files and decides again on the calls it touches.

The store is a log of epochs below one folder; nothing that is committed is written again:

* ``rows/epoch=E/kb=B``: the calls of the files that E accepted, with ``is_dup`` as E saw it, dealt by
  a hash of their key, so what shares a key lies in one bucket;
* ``files/epoch=E``: the fingerprints of those files. The newest epoch of a file has its calls, older
  ones are replaced;
* ``flips/epoch=E``: calls of former epochs whose verdict E changed;
* ``commits/epoch=E``: written last. Without it the epoch doesn't count, and another attempt overwrites it.

A batch reads the key columns of what is stored and writes what it brings, and the verdicts that it
changes: only the keys that it touches are decided again. Of the calls with one key the first to be stored counts (``stored``, the
epoch that brought it), the lowest id within an epoch. ``compact`` folds all epochs into one. The store
and the stream's checkpoint belong together: epochs are the numbers of its batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.asof import small
from ..operators.dedup import dedup_flag
from ..sources.ingest import FINGERPRINT

FILE = ["machine_id", "file_path"]
KEY = ["account_uuid", "dk"]
BUCKETS = 64


class FileStore:
    """Calls (with the columns of ``schema``: file, key and id among them) in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, order: str = "rid", buckets: int = BUCKETS):
        self.spark, self.path, self.order, self.buckets = spark, path.rstrip("/"), order, buckets
        self.columns = schema.fieldNames()
        flag, epoch = T.StructField("is_dup", T.BooleanType()), T.StructField("epoch", T.LongType())
        own = lambda names: [schema[c] for c in names]
        self._schemas = {
            "rows": T.StructType([*schema.fields, flag, T.StructField("stored", T.LongType()), epoch, T.StructField("kb", T.IntegerType())]),
            "files": T.StructType([*own(FILE), T.StructField("mtime_ns", T.LongType()), T.StructField("size", T.LongType()), epoch]),
            "flips": T.StructType([*own([*KEY, order]), T.StructField("row_epoch", T.LongType()), flag, epoch]),
            "commits": T.StructType([T.StructField("n", T.LongType()), epoch]),
        }

    def _read(self, name: str, upto: int) -> DataFrame:
        """The epochs up to ``upto``; folders of others aren't listed in the plan."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self._schemas[name])
        return self.spark.read.schema(self._schemas[name]).parquet(f"{self.path}/{name}").where(F.col("epoch") <= upto)

    def _write(self, name: str, df: DataFrame, epoch: int, *by: str) -> None:
        # an epoch's folder is its own: a second attempt at it replaces the first
        df.drop("epoch").write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{name}/epoch={epoch}")

    def committed(self) -> int:
        """The newest epoch that counts; -1 without any."""
        newest = self._read("commits", 1 << 62).agg(F.max("epoch")).first()[0]
        return -1 if newest is None else newest

    def fingerprints(self, upto: int | None = None) -> DataFrame:
        """(machine_id, file_path, mtime_ns, size, epoch) of the stored files."""
        upto = self.committed() if upto is None else upto
        newest = F.max_by(F.struct("mtime_ns", "size", "epoch"), "epoch").alias("r")
        return self._read("files", upto).groupBy(*FILE).agg(newest).select(*FILE, "r.*")

    def _standing(self, upto: int, files: DataFrame) -> DataFrame:
        """Rows that no later file replaced, with the newest verdict."""
        rows = self._read("rows", upto).join(small(files.select(*FILE, "epoch")), [*FILE, "epoch"], "left_semi")
        last = self._read("flips", upto).groupBy(F.col(self.order).alias("__id"), F.col("row_epoch").alias("__e")).agg(F.max_by("is_dup", "epoch").alias("__now"))
        same = (F.col(self.order) == F.col("__id")) & (F.col("epoch") == F.col("__e"))
        return rows.join(small(last), same, "left").withColumn("is_dup", F.coalesce("__now", "is_dup")).drop("__id", "__e", "__now")

    def current(self, upto: int | None = None) -> DataFrame:
        """All calls with ``is_dup``."""
        upto = self.committed() if upto is None else upto
        return self._standing(upto, self.fingerprints(upto)).select(*self.columns, "is_dup")

    def apply(self, rows: DataFrame, files: DataFrame, epoch: int) -> bool:
        """Replaces ``files`` (machine_id, file_path, mtime_ns, size) by their ``rows``; False if the epoch was committed before.

        A file whose fingerprint is stored already is passed over.
        """
        done = self.committed()
        if epoch <= done:
            return False
        known = self.fingerprints(done)
        fresh = files.join(known.select("machine_id", *FINGERPRINT), ["machine_id", *FINGERPRINT], "left_anti")
        self._write("files", fresh.select(*FILE, "mtime_ns", "size"), epoch)
        fresh = self.spark.read.schema(self._schemas["files"]).parquet(f"{self.path}/files/epoch={epoch}").select(*FILE)
        bucket = F.pmod(F.when(F.coalesce("dk", F.lit("")) == "", F.xxhash64(self.order)).otherwise(F.xxhash64(*KEY)), F.lit(self.buckets)).cast("int")
        new = rows.join(small(fresh), FILE, "left_semi").select(*self.columns).withColumns({"stored": F.lit(epoch).cast("long"), "epoch": F.lit(epoch).cast("long"), "kb": bucket})
        replaced = known.join(fresh, FILE, "left_semi")
        narrow = [*FILE, *KEY, self.order, "is_dup", "stored", "epoch", "kb"]
        keyed = self._standing(done, known).select(*narrow).where("dk <> ''")
        gone = keyed.join(small(replaced.select(*FILE)), FILE, "left_semi")
        touched = gone.select(*KEY).unionByName(new.where("dk <> ''").select(*KEY)).distinct()
        # the former holders of a touched key that stay, and its new ones, stand in the order in which they were stored
        stay = keyed.join(small(replaced.select(*FILE)), FILE, "left_anti").join(small(touched), KEY, "left_semi").withColumn("__was", F.col("is_dup"))
        both = stay.unionByName(new.select(*[c for c in narrow if c != "is_dup"]), allowMissingColumns=True).withColumn("__place", F.struct("stored", self.order))
        decided = dedup_flag(both.drop("is_dup"), "__place")
        flips = decided.where((F.col("epoch") < epoch) & (F.col("is_dup") != F.col("__was"))).select(*KEY, self.order, F.col("epoch").alias("row_epoch"), "is_dup")
        self._write("flips", flips, epoch)
        verdict = decided.where(F.col("epoch") == epoch).select(self.order, "is_dup")
        self._write("rows", new.join(verdict, self.order), epoch, "kb")
        self._write("commits", self.spark.range(1).select(F.lit(1).cast("long").alias("n")), epoch)
        return True

    def compact(self) -> None:
        """One epoch in place of all, in a new folder beside the store that readers then open."""
        upto = self.committed()
        files = self.fingerprints(upto)
        other = FileStore(self.spark, f"{self.path}-{upto}", T.StructType(self._schemas["rows"].fields[: len(self.columns)]), self.order, self.buckets)
        rows = self._standing(upto, files)
        other._write("rows", rows.select(*self.columns, "is_dup", "stored", "kb"), upto, "kb")
        other._write("files", files.select(*FILE, "mtime_ns", "size"), upto)
        other._write("commits", self.spark.range(1).select(F.lit(1).cast("long").alias("n")), upto)
        self.path = other.path


def newest_sending(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, files) of a batch in which a file may come more than once: its last sending (``sent``, rising) counts."""
    last = F.max("sent").over(Window.partitionBy(*FILE))
    rows = batch.withColumn("__last", last).where(F.col("sent") == F.col("__last")).drop("__last")
    files = rows.groupBy(*FILE).agg(F.max("mtime_ns").alias("mtime_ns"), F.max("size").alias("size"))
    return rows, files


def follow(sendings: DataFrame, store: FileStore, checkpoint: str):
    """A query that stores each batch of the stream ``sendings`` (the columns of calls, mtime_ns, size, sent) under its number.

    A batch that is run again finds its epoch committed, or overwrites what it had begun.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        try:
            store.apply(*newest_sending(kept), epoch)
        finally:
            kept.unpersist()

    return sendings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
