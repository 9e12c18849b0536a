"""Benchmark decontamination over a positional inverted index.

``build_index`` writes one posting (term, document, position) for each document word that
some benchmark item uses, with exact positions. ``phrase_matches`` takes each 13-word window's
rarest two terms, shifts their postings by the terms' offsets, and intersects them; what is
left is checked term by term against the index. ``proximity_matches`` asks the same lists for
the rare terms of an item within a distance of each other.

A document is known by (doc_id, hash of its text), so repeated ids with different texts stay
apart and repeated rows get the same answer. Null and empty texts have no words; null ids are
joined null-safely. Benchmark rows without an item_id still mark words as hit, but are not
listed. An empty benchmark or corpus gives zero counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, materialize, null_safe

SPAN = 13
#: Rows up to which the benchmark's vocabulary, anchors or candidate documents are broadcast.
BROADCAST_ROWS = 1_000_000
_END, _GAP = -1, -2


def split_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters; may begin or end with an empty string."""
    return F.split(ascii_lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


@dataclass
class Index:
    postings: DataFrame  # term, doc_id, h, pos; terms -1 and -2 carry each text's length
    items: DataFrame  # item, item_id, n, ipos, term, word


def build_index(docs: DataFrame, bench: DataFrame) -> Index:
    items = bench.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    items = items.withColumn("item", F.monotonically_increasing_id())
    words = F.filter(split_words(F.col("text")), lambda x: x != "")
    tokens = materialize(items.select("item", "item_id", F.size(words).alias("n"), F.posexplode(words).alias("ipos", "word")), "bench")
    vocabulary = tokens.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
    vocabulary = materialize(vocabulary.unionByName(
        docs.sparkSession.createDataFrame([(" ", _END), ("", _GAP)], "word string, term long")
    ), "vocabulary")
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    every = F.concat(split_words(F.coalesce(F.col("text"), F.lit(""))), F.array(F.lit(" ")))
    postings = source.select("doc_id", "h", F.posexplode(every).alias("pos", "word")).join(bounded(vocabulary, BROADCAST_ROWS), "word")
    return Index(
        materialize(postings.select("term", "doc_id", "h", "pos"), "postings"),
        tokens.join(bounded(vocabulary, BROADCAST_ROWS), "word").select("item", "item_id", "n", "ipos", "term", "word"),
    )


def lengths(index: Index) -> DataFrame:
    """Words of each text, from the two marks that every text has in the index."""
    marks = index.postings.where(F.col("term") < 0)
    return marks.groupBy("doc_id", "h").agg(
        (F.max(F.when(F.col("term") == _END, F.col("pos"))) - F.count_distinct(F.when(F.col("term") == _GAP, F.col("pos")))).cast("long").alias("n_words"),
        F.sum((F.col("term") == _END).cast("long")).alias("copies"),
    )


def _frequencies(index: Index) -> DataFrame:
    return index.postings.where(F.col("term") >= 0).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


def _anchors(index: Index, span: int, n_anchors: int = 2) -> DataFrame:
    """(item, key, ipos, term, need): for each window the positions of its rarest terms; equal sets once."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - span, F.lit(0)))
    windows = index.items.select("item", "n", "ipos", "term").join(_frequencies(index), "term", "left").select(
        "item", "n", "ipos", "term", F.coalesce("cf", F.lit(0)).alias("cf"), F.explode(starts).alias("start")
    ).where((F.col("ipos") >= F.col("start")) & (F.col("ipos") < F.col("start") + span))
    rarest = F.row_number().over(Window.partitionBy("item", "start").orderBy("cf", "ipos"))
    picked = windows.withColumn("rank", rarest).where(F.col("rank") <= n_anchors)
    sets = picked.groupBy("item", "start").agg(
        F.sort_array(F.collect_list(F.struct("ipos", "term"))).alias("at"), F.min("cf").alias("least")
    ).where(F.col("least") > 0).select("item", "at").distinct()
    return sets.select("item", F.xxhash64("at").alias("key"), F.size("at").alias("need"), F.explode("at").alias("a")).select(
        "item", "key", "need", F.col("a.ipos").alias("ipos"), F.col("a.term").alias("term")
    )


def phrase_matches(index: Index, span: int = SPAN) -> DataFrame:
    """(doc_id, h, item, item_id, pos): document words inside an occurrence of a window."""
    anchors = bounded(materialize(_anchors(index, span), "anchors"), BROADCAST_ROWS)
    shifted = index.postings.join(anchors, "term").select(
        "doc_id", "h", "item", "key", "need", "ipos", (F.col("pos") - F.col("ipos")).alias("shift")
    )
    met = shifted.groupBy("doc_id", "h", "item", "key", "shift").agg(F.count_distinct("ipos").alias("met"), F.first("need").alias("need"))
    found = materialize(met.where(F.col("met") == F.col("need")).select("doc_id", "h", "item", "shift").distinct(), "candidates")
    suspects = bounded(found.select("doc_id", "h").distinct(), BROADCAST_ROWS)
    own = null_safe(index.postings.where(F.col("term") >= 0), suspects, ["doc_id", "h"], "left_semi").distinct()
    wanted = found.join(bounded(index.items, BROADCAST_ROWS), "item").select(
        "doc_id", "h", "item", "item_id", "n", "shift", "ipos", "term", (F.col("ipos") + F.col("shift")).cast("int").alias("pos")
    )
    same = null_safe(wanted, own, ["doc_id", "h", "pos", "term"], "left_semi")
    line = Window.partitionBy("doc_id", "h", "item", "shift").orderBy("ipos")
    runs = same.withColumn("run", F.col("ipos") - F.row_number().over(line))
    length = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "h", "item", "shift", "run"))
    return runs.withColumn("long", length).where(F.col("long") >= F.least(F.lit(span), F.col("n"))).select(
        "doc_id", "h", "item", "item_id", "pos"
    )


def proximity_matches(index: Index, distance: int = 8, n_terms: int = 2, min_words: int = 3) -> DataFrame:
    """(doc_id, h, item, item_id, end_pos): items whose rarest terms all stand within ``distance`` positions.

    The item's rarest ``n_terms`` distinct terms are looked up, of equally rare ones the first by
    spelling; a term that no document holds is the rarest of all, and its item then matches nothing.
    A document matches where each of them has a posting in the same stretch. Stretches overlap by
    ``distance``, so none is missed; each posting counts in the two stretches of twice that length that hold it.
    """
    rare = Window.partitionBy("item").orderBy("cf", "word")
    terms = index.items.where(F.col("n") >= min_words).select("item", "item_id", "term", "word").distinct().join(_frequencies(index), "term", "left").fillna(0, ["cf"])
    terms = terms.withColumn("rank", F.row_number().over(rare)).where(F.col("rank") <= n_terms)
    need = terms.groupBy("item").agg(F.count(F.lit(1)).alias("need"), F.min("cf").alias("least")).where(F.col("least") > 0)
    terms = materialize(terms.join(need, "item").select("item", "item_id", "term", "need"), "near")
    cell = F.floor(F.col("pos") / distance).cast("long")
    hits = index.postings.join(bounded(terms, BROADCAST_ROWS), "term").withColumn("cell", F.explode(F.array(cell, cell - 1)))
    # a stretch without all of the terms goes before its positions are gathered
    counted = hits.groupBy("doc_id", "h", "item", "item_id", "need", "cell").agg(
        F.collect_set(F.struct("pos", "term")).alias("at"), F.count_distinct("term").alias("kinds")
    ).where(F.col("kinds") == F.col("need"))
    met = counted.withColumn("at", F.sort_array("at"))
    kinds = lambda at, end: F.size(F.array_distinct(F.transform(
        F.filter(at, lambda q: (q["pos"] <= end) & (q["pos"] >= end - distance)), lambda q: q["term"])))
    ends = F.filter(F.transform(F.col("at"), lambda p: F.when(kinds(F.col("at"), p["pos"]) == F.col("need"), p["pos"])), lambda x: x.isNotNull())
    return met.withColumn("ends", ends).where(F.size("ends") > 0).groupBy("doc_id", "h", "item", "item_id").agg(
        F.min(F.col("ends")[0]).alias("end_pos")
    )


def contamination(docs: DataFrame, bench: DataFrame, span: int = SPAN, proximity: bool = False) -> DataFrame:
    """Per distinct (doc_id, text): n_words, n_hit, items, contaminated, and how many rows share it; with ``proximity`` n_near, the items near."""
    index = build_index(docs, bench)
    hits = phrase_matches(index, span)
    per = hits.groupBy("doc_id", "h").agg(
        F.count_distinct("pos").alias("n_hit"), F.collect_set(F.col("item_id").cast("string")).alias("items")
    )
    out = null_safe(lengths(index), per, ["doc_id", "h"], "left")
    more = []
    if proximity:
        near = proximity_matches(index).groupBy("doc_id", "h").agg(F.count_distinct("item_id").alias("n_near"))
        out = null_safe(out, near, ["doc_id", "h"], "left")
        more = [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")]
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "h", "n_words", hit.alias("n_hit"),
        F.coalesce(F.sort_array("items"), F.array().cast("array<string>")).alias("items"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), "copies", *more,
    )
