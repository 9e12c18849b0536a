"""The pipeline's stages, each against what it should keep."""

from __future__ import annotations

import corpus_pipeline
from tallyframe.llm import line_crf
from tallyframe.llm.common import table

from ..conftest import SMALL
from . import brute


def test_pipeline(spark, duck):
    docs, columns = table(spark, SMALL, "documents"), None
    columns = docs.columns
    quality, dedup, clean, private, pack = (f for _, f in corpus_pipeline.STAGES)

    kept = quality(spark, docs, SMALL).cache()
    score = {r["doc_id"]: r["predicted"] for r in line_crf.score(docs, table(spark, SMALL, "labels")).collect()}
    assert kept.columns == columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, p in score.items() if p}

    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    first = {c for _, c in brute.op7(rows).values()}
    single = dedup(spark, kept, SMALL).cache()
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(first)

    bench = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    bad = {i for i, v in brute.op2([(r["doc_id"], r["text"]) for r in single.collect()], bench).items() if v[-1]}
    rest = clean(spark, single, SMALL).cache()
    assert rest.columns == columns and {r["doc_id"] for r in rest.collect()} == first - bad

    hidden = private(spark, rest, SMALL).cache()
    assert hidden.columns == columns and hidden.count() == rest.count()
    assert not any(brute.op8_base(r["text"]) for r in hidden.collect())
    assert all(len(r["text"]) == r["n_chars"] for r in hidden.collect())

    packed = pack(spark, hidden, SMALL).collect()
    assert {r["doc_id"] for r in packed} == first - bad


def test_awkward_rows_pass_through(spark):
    rows = [(1, None, "en", "x", 0, 7), (1, None, "en", "x", 0, 7), (None, "plain words in a good sentence here.", "en", "x", 0, 7), (3, "plain words in a good sentence here.", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h int")
    single = corpus_pipeline.simhash_near_dedup(spark, docs, SMALL)
    assert single.columns == docs.columns and sorted(str(r["doc_id"]) for r in single.collect()) == ["1", "3"]
    assert corpus_pipeline.benchmark_decontamination(spark, docs, SMALL).count() == 4
    assert corpus_pipeline.pii_redaction(spark, docs, SMALL).count() == 4
    assert corpus_pipeline.quality_classifier(spark, docs, SMALL).columns == docs.columns


def test_columns_of_any_name_keep_their_values(spark):
    rows = [(1, "some plain words here", 5, 6, 7, "a"), (2, "other plain words there", 8, 9, 10, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash int, copy_number int, h long, item string")
    for stage in (corpus_pipeline.simhash_near_dedup, corpus_pipeline.benchmark_decontamination, corpus_pipeline.pii_redaction):
        assert sorted(map(tuple, stage(spark, docs, SMALL).collect())) == rows
