"""Ids that are strings, and label tables with repeated, contradictory and null rows: the same results as plain ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import ctw, decontaminate, licences, line_crf, packing, pii, quality_rules, queries, sharding, simhash, token_counts

from ..conftest import SMALL
from .test_operators import AWKWARD


@pytest.fixture(scope="module")
def both(spark):
    """The awkward rows under ids of three digits, which sort alike as numbers and as strings."""
    rows = [(None if i is None else 100 + i, t, "x") for i, t in AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(2)
    return docs, docs.withColumn("doc_id", F.col("doc_id").cast("string"))


def marks(spark, kind):
    rows = [(100 + i, 0 if i % 2 else 1) for i in range(1, 13)]
    return spark.createDataFrame(rows, "doc_id long, quality int").withColumn("doc_id", F.col("doc_id").cast(kind))


def bench(spark):
    return spark.createDataFrame([("b1", "same words here again"), ("b2", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), ("b3", None)], "item_id string, text string")


OPERATORS = {
    "op1": lambda s, d, kind: quality_rules.apply_rules(d, marks(s, kind)),
    "op2": lambda s, d, kind: decontaminate.contamination(d, bench(s), proximity=True),
    "op4": lambda s, d, kind: packing.pack_documents(d, queries.tokenizer("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "op5": lambda s, d, kind: token_counts.token_counts(d, queries.tokenizer("byte_bpe_50k.json")),
    "op6": lambda s, d, kind: ctw.score(d).withColumn("score", F.round("score", 6)).withColumn("base_score", F.round("base_score", 6)).withColumn("bits_per_byte", F.round("bits_per_byte", 6)),
    "op7": lambda s, d, kind: simhash.near_duplicates(d),
    "op8": lambda s, d, kind: pii.find_spans(d).select("doc_id", "base"),
    "op9": lambda s, d, kind: line_crf.score(d, marks(s, kind)).select("doc_id", "held_out"),
    "op10": lambda s, d, kind: licences.scan(d),
}


@pytest.mark.parametrize("op", OPERATORS)
def test_string_ids_give_what_numbers_give(spark, both, op):
    plain, text = (OPERATORS[op](spark, d, kind) for d, kind in zip(both, ("long", "string")))
    assert text.schema["doc_id"].dataType.simpleString() == "string"
    key = lambda df: sorted(repr(tuple(str(v) if c in ("doc_id", "component_id") and v is not None else v for c, v in r.asDict().items())) for r in df.collect())
    assert key(plain) == key(text) and text.count() > 0


def test_string_ids_are_sharded(spark, both):
    got = sharding.shard_documents(both[1], n_shards=3).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in both[1].collect())
    assert max(n := [sum(r["shard"] == k for r in got) for k in range(3)]) - min(n) <= 1


@pytest.mark.parametrize("learner", ["rules", "field"])
def test_repeated_and_null_labels_change_nothing(spark, learner):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    plain = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    odd = plain.unionByName(plain).unionByName(plain.withColumn("quality", F.lit(None).cast(plain.schema["quality"].dataType)))
    odd = odd.unionByName(plain.limit(1).withColumn("doc_id", F.lit(None).cast(plain.schema["doc_id"].dataType)))
    judge = (lambda x: quality_rules.apply_rules(docs, x)) if learner == "rules" else (lambda x: line_crf.score(docs, x))
    assert sorted(map(tuple, judge(odd).collect())) == sorted(map(tuple, judge(plain).collect()))


def test_a_contradicted_label_counts_as_bad(spark):
    docs = spark.createDataFrame([(k, f"some plain words number {k} that stand in a row here as text goes") for k in range(6)], "doc_id long, text string")
    twice = spark.createDataFrame([(k, q) for k in range(6) for q in ((0, 1) if k < 3 else (1,))], "doc_id long, quality int")
    got = quality_rules.labelled_statistics(docs, twice).groupBy("bad").count().collect()
    assert {r["bad"]: r["count"] for r in got} == {True: 3, False: 3}


def test_scoring_leaves_no_table_behind(spark, both):
    before = {t.name for t in spark.catalog.listTables()}
    assert ctw.score(both[0]).count() == both[0].count()
    assert {t.name for t in spark.catalog.listTables()} == before
