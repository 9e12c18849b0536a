"""SimHash near-dedup with BK-trees.

Fingerprints within ``radius`` bits agree in at least one of radius + 1 parts, so each
distinct fingerprint goes to one shard for each of its parts. A shard's BK-tree keys children
by their Hamming distance to the parent, and a query follows only the edges within the radius.
Trees live in the task that owns the shard: together they grow with the corpus, so they are
never broadcast. Shards over ``max_shard`` fingerprints are dealt out again over the bits they
do not share, by the same argument, until they fit; nothing is dropped. Links inside a shard
become stars, and large-star / small-star rounds join the stars of all shards.

Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows and
equal texts share a fingerprint and a component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

SEED = 42


def fingerprint(text: str | None, width: int = 3) -> bytes:
    """8 bytes: a bit is 1 if it is set in over half the hashes of the word shingles."""
    words = (text or "").encode().lower().split()  # on bytes only A-Z change and only \t\n\v\f\r and space part
    if not words:
        return bytes(8)
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    first = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_digest
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = slice(at, min(n, at + (1 << 16)))
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[part].tolist(), (ends[width - 1 :][part] - 1).tolist())])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, h, fp): a hash of the text, and the 64 bits as a signed long."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("h", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = b"".join(fingerprint(x.as_py(), width) for x in batch.column(2))
            fp = np.frombuffer(prints, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "h", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, schema)


class BKTree:
    """Children keyed by the integer distance to their parent."""

    def __init__(self):
        self.root: list | None = None  # [value, {distance: node}]

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            v, children = stack.pop()
            d = (v ^ value).bit_count()
            if d <= radius:
                found.append(v)
            for e in range(max(1, d - radius), d + radius + 1) if len(children) > 2 * radius else tuple(children):
                if d - radius <= e <= d + radius and e in children:
                    stack.append(children[e])
        return found


def stars(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, representative) for the values of a shard that have a neighbour."""
    tree, up = BKTree(), {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for v in values:
        up[v] = v
        for near in tree.within(v, radius):
            a, b = top(v), top(near)
            if a != b:
                up[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, t) for v in values if (t := top(v)) != v]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(path_masks: dict[str, int], path: str, radius: int) -> list[tuple[str, int]]:
    """The shards below a path: its mask with one of radius + 1 parts of the other bits added."""
    fixed = path_masks[path]
    free = [b for b in range(64) if not fixed >> b & 1]
    k, out = radius + 1, []
    for j in range(k):
        own = free[j * len(free) // k : (j + 1) * len(free) // k]
        out.append((f"{path}{j}", fixed | sum(1 << b for b in own)))
    return out


def links(prints: DataFrame, radius: int = 2, max_shard: int = 4096, levels: int = 5) -> DataFrame:
    """(a, b): stars that connect distinct fingerprints (column fp) within ``radius`` bits."""
    masks = {"": 0}
    shards = []
    rows = prints.select("fp", F.lit("").alias("path"))
    for level in range(levels):
        paths = [p for p in masks if len(p) == level]
        below = {p: _parts(masks, p, radius) for p in paths}
        for kids in below.values():
            masks |= dict(kids)
        kid = F.create_map(*[x for p in paths for x in (F.lit(p), F.array(*[F.struct(F.lit(c).alias("path"), F.lit(_signed(m)).alias("mask")) for c, m in below[p]]))])
        dealt = rows.select("fp", F.explode(kid[F.col("path")]).alias("s")).select("fp", F.col("s.path").alias("path"), F.col("fp").bitwiseAND(F.col("s.mask")).alias("value"))
        sizes = dealt.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        sized = materialize(dealt.join(sizes, ["path", "value"]), "shards")
        last = level == levels - 1
        shards.append(sized if last else sized.where(F.col("n") <= max_shard))
        rows = sized.where(F.col("n") > max_shard).select("fp", "path")
        if last or rows.isEmpty():
            break
    every = shards[0]
    for s in shards[1:]:
        every = every.unionByName(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for path, value, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, value) != key:
                    out += stars(held, radius)
                    key, held = (path, value), []
                held.append(fp & 0xFFFFFFFFFFFFFFFF)
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        out += stars(held, radius)
        if out:
            yield _pairs(out)

    ordered = every.select("path", "value", "fp").repartition("path", "value").sortWithinPartitions("path", "value")
    return materialize(ordered.mapInArrow(run, "a long, b long").distinct(), "stars")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = [pa.array([_signed(x[k]) for x in out], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for nodes with edges (a, b); large-star and small-star by turns."""

    def low(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    before = None
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(low(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v"))
        down = materialize(down, "large-star")
        small = down.join(low(down), "u")
        edges = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = materialize(edges.where(F.col("a") != F.col("b")).distinct(), "small-star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("the components did not settle")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, max_shard: int = 4096) -> DataFrame:
    """(doc_id, h, fp, root, component_id): the smallest fingerprint and doc_id that a chain of links reaches."""
    prints = materialize(fingerprints(docs, width), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes, radius, max_shard))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(firsts, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "h", "fp", "root", "component_id")
