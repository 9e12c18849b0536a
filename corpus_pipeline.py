"""The corpus pipeline: five operators one after the other, each written and read again.

A stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the
last return the columns of ``documents``; columns they don't know pass through. Null and empty
texts: the classifier scores them like any text; in near-dedup they are copies of each other;
without words they are never contaminated; they hold no personal data; and they pack as one
end token. Of equal rows one stays after near-dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, line_crf, packing, pii, queries, simhash
from tallyframe.llm.common import materialize, null_safe, table, unused


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores under its threshold."""
    return line_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each component; of repeated rows, one."""
    rank = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "h")
    first = simhash.near_duplicates(docs).groupBy("root").agg(F.min(rank).alias("first"))
    h, copy = unused(docs, "text_hash"), unused(docs, "copy_number")
    first = materialize(first.select(F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias(h)), "first")
    kept = null_safe(docs.withColumn(h, F.xxhash64("text")), first, ["doc_id", h], "left_semi")
    one = Window.partitionBy("doc_id", h).orderBy("text")
    return kept.withColumn(copy, F.row_number().over(one)).where(F.col(copy) == 1).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = materialize(found.where("contaminated").select("doc_id", "h"), "contaminated")
    h = unused(docs, "text_hash")
    return null_safe(docs.withColumn(h, F.xxhash64("text")), bad.withColumnRenamed("h", h), ["doc_id", h], "left_anti").select(*docs.columns)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", pii_redaction),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs


#: Trained stages have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None
