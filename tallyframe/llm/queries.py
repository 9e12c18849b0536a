"""The registered queries: each puts one operator on its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, hard_negatives, licences, line_crf, packing, pii, quality_rules, sharding, simhash, token_counts, warc, whiten
from .common import table


def tokenizer(name: str) -> str:
    """A vocabulary file's place; only these queries name the files, the operators take paths."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), proximity=True)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_near",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s.startswith(f"{k}:"))).cast("long")
    counts = {f"n_{k}": of_kind(k) for k in pii.KINDS}
    out = found.withColumns(counts | {"base_sha256": F.sha2(F.concat_ws(",", "base"), 256)})
    return out.select("doc_id", *counts, "base_sha256", F.concat_ws(",", "spans").alias("spans"))


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives.mine(rows.withColumn("label", F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_decontamination, op3_sharding, op4_packing, op5_token_counts,
        op6_context_tree, op7_simhash, op8_pii, op9_line_crf, op10_licences, op11_warc, op12_whitening, op13_hard_negatives,
    )
}
#: DuckDB twins where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op10_licences": licences.oracle(),
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS q
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.id) QUALIFY rank <= 5
""",
    "op11_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), x AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS d FROM p),
y AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM x)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM y
""",
    "op2_decontamination": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), spans AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM spans),
grams AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, item_id, grams.n, s FROM grams JOIN spans ON grams.g = spans.g AND grams.n = spans.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY 1),
freq AS (SELECT u AS term, count(*) AS cf FROM (SELECT unnest(w) AS u FROM words) GROUP BY 1),
terms AS (
  SELECT item_id, term, coalesce(cf, 0) AS cf FROM (SELECT DISTINCT item_id, unnest(w) AS term FROM items WHERE len(w) >= 3) LEFT JOIN freq USING (term)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY coalesce(cf, 0), term) <= 2
),
rare AS (SELECT item_id, min(term) AS a, max(term) AS b FROM terms GROUP BY 1),
post AS (SELECT doc_id, u, p FROM (SELECT doc_id, unnest(w) AS u, unnest(range(len(w))) AS p FROM words) WHERE u IN (SELECT term FROM terms)),
nearby AS (
  SELECT x.doc_id, count(DISTINCT item_id) AS n_near FROM rare JOIN post x ON x.u = a JOIN post y ON y.u = b AND y.doc_id = x.doc_id AND abs(x.p - y.p) <= 8 GROUP BY 1
),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS i FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY 1)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
       sha256(coalesce(i, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN nearby USING (doc_id)
""",
}
