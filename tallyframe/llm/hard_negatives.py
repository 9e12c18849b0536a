"""Hard negatives by an STR-packed R-tree.

All rows are packed into R-trees: Spark deals them into slabs by label and by the coordinate that
varies most, and each task tiles its slab by the next coordinates in turn (sort-tile-recursive)
down to leaves of ``LEAF`` rows; boxes above them hold ``FANOUT`` boxes each. A box gives an
interval of the inner products with an anchor, coordinate by coordinate. The anchors visit the
slabs in blocks; in each tree a queue opens the box with the highest bound first and passes over
boxes that lie outside every score window of the anchor or strictly below its k-th best score.
A slab's best few rows an anchor and window are merged over the slabs. Positives are found first,
in the trees of the anchor's own label with an open window; then the negatives in all others.

The work is the anchors times the slabs they visit: with one row in a hundred an anchor it grows
with the square of the rows, less what the boxes prune. Slabs hold ``SLAB`` times the root of the
number of rows (``LARGEST_SLAB`` at most), so an anchor is sent to as many slabs as that root
allows, and a task holds one slab and a batch of anchors; of more than ``VISITORS`` anchors each
share meets a copy of the slab.

Rows with a null id, a null label, a null or empty vector, or null or non-finite components take no
part, nor do components whose whole number exceeds 2^53, or vectors of another length than most
rows have (the longer on a tie). Equal anchor rows count once; other repeated rows each take their
place; an anchor's own id is never its positive. Pairs whose score no long holds are left out. Ties
go to the smaller id. Without anchors or rows there is no result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .whiten import _matrix, usable, usual_length

LEAF, FANOUT = 128, 16
SLAB, LARGEST_SLAB = 32, 1 << 18
#: Anchors that share a queue, anchors that visit a slab in one task, and rows of a tree in one message.
BLOCK, VISITORS, TREE_ROWS = 64, 1 << 17, 4096


# -- packing ---------------------------------------------------------------------------------------


def tiled(q: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The order of rows that puts each run of ``LEAF`` into one tile: slabs along the first axis, each cut along the next."""
    leaves = math.ceil(len(q) / LEAF)
    if leaves <= 1 or not len(axes):
        return np.arange(len(q))
    deep = min(len(axes), max(1, math.ceil(math.log2(leaves))))
    slabs = math.ceil(leaves ** (1 / deep) - 1e-9)
    step = LEAF * math.ceil(leaves / slabs)
    order = np.argsort(q[:, axes[0]], kind="stable")
    return np.concatenate([part[tiled(q[part], axes[1:deep])] for part in (order[k : k + step] for k in range(0, len(order), step))])


class Tree:
    """Boxes over rows that are in tiled order: level 0 are the leaves, the last level the top."""

    def __init__(self, ids: np.ndarray, q: np.ndarray):
        """``q``: floats where all inner products are exact so, else Python's numbers."""
        self.ids, self.q = ids, q
        low, high = (f.reduceat(q, np.arange(0, len(q), LEAF), axis=0) for f in (np.minimum, np.maximum))
        self.levels = [(low, high)]
        while len(low) > FANOUT:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at, axis=0), np.maximum.reduceat(high, at, axis=0)
            self.levels.append((low, high))

    def bounds(self, level: int, start: int, end: int, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with the boxes of a level: every coordinate takes its own corner."""
        low, high = (x[start:end].T for x in self.levels[level])
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        return up @ low + down @ high, up @ high + down @ low


class Best:
    """The k best of each window (from, to) of each anchor; higher scores first, then smaller ids."""

    def __init__(self, windows: np.ndarray, k: int):
        self.low, self.high, self.k = windows[:, :, 0].copy(), windows[:, :, 1], k
        self.found: list[list[list[tuple]]] = [[[] for _ in range(windows.shape[1])] for _ in range(len(windows))]

    def meets(self, least: np.ndarray, most: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Whether a box can still give an anchor anything: it reaches into a window, and not strictly below that window's k-th."""
        return ((most[:, :, None] >= self.low[who][:, None, :]) & (least[:, :, None] <= self.high[who][:, None, :])).any(axis=2)

    def take(self, scores: np.ndarray, ids: np.ndarray, who: np.ndarray, own: np.ndarray) -> None:
        """``own``: the ids that an anchor may not take."""
        fits = (scores[:, :, None] >= self.low[who][:, None, :]) & (scores[:, :, None] <= self.high[who][:, None, :])
        fits &= (ids[None, :] != own[who][:, None])[:, :, None]
        for i, w in zip(*np.nonzero(fits.any(axis=1))):
            rows = np.flatnonzero(fits[i, :, w])
            a = who[i]
            kept = heapq.nsmallest(self.k, self.found[a][w] + [(-s, n) for s, n in zip(scores[i, rows].tolist(), ids[rows].tolist())])
            self.found[a][w] = kept
            if len(kept) == self.k:
                self.low[a, w] = max(self.low[a, w], -kept[-1][0])


def search(tree: Tree, anchors: np.ndarray, own: np.ndarray, best: Best, who: np.ndarray) -> None:
    """Adds a tree's rows to ``best`` for the anchors ``who``, highest bound first."""
    queue: list[tuple] = []
    count = 0

    def push(level: int, start: int, end: int, at: np.ndarray) -> None:
        nonlocal count
        least, most = tree.bounds(level, start, end, anchors[at])
        meets = best.meets(least, most, at)
        for k in np.flatnonzero(meets.any(axis=0)):
            alive = meets[:, k]
            heapq.heappush(queue, (-most[alive, k].max(), count, level, start + k, at[alive], least[alive, k], most[alive, k]))
            count += 1

    push(len(tree.levels) - 1, 0, len(tree.levels[-1][0]), who)
    while queue:
        _, _, level, k, at, least, most = heapq.heappop(queue)
        at = at[best.meets(least[:, None], most[:, None], at)[:, 0]]
        if not len(at):
            continue
        if level:
            push(level - 1, k * FANOUT, min((k + 1) * FANOUT, len(tree.levels[level - 1][0])), at)
        else:
            rows = slice(k * LEAF, (k + 1) * LEAF)
            best.take(anchors[at] @ tree.q[rows].T, tree.ids[rows], at, own)


# -- on Spark --------------------------------------------------------------------------------------


def narrowed(q: np.ndarray) -> np.ndarray:
    """The shortest whole numbers that hold a tile; its bytes tell which."""
    most = max(abs(int(q.min())), abs(int(q.max())))
    return q.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _tile(ids: bytes, flat: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(flat, f"i{len(flat) // (len(own) * d)}").reshape(-1, d)


def pack(rows: DataFrame, d: int, slabs: int) -> DataFrame:
    """(slab, label, part, ids, flat): every row once, in tiled order, ``TREE_ROWS`` at a time.

    Rows are dealt by label, the coordinate of greatest variance and a hash of the row, so neither a
    large label nor a vector that many rows have makes a slab larger than others.
    """
    spread = rows.select([F.variance(F.col("q")[k].cast("double")).alias(f"v{k}") for k in range(d)]).first()
    axes = np.argsort([-(spread[k] or 0.0) for k in range(d)], kind="stable")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(parts)  # one slab
        if not sum(p.num_rows for p in got):
            return
        whole = pa.Table.from_batches(got)
        slab, label, ids = (whole.column(c).to_numpy() for c in ("slab", "label", "id"))
        q = _matrix(whole.column("q"))
        for value in np.unique(label):
            own = np.flatnonzero(label == value)
            own = own[tiled(q[own], axes)]
            for part, k in enumerate(range(0, len(own), TREE_ROWS)):
                at = own[k : k + TREE_ROWS]
                yield pa.record_batch({
                    "slab": pa.array([slab[0]], pa.int32()), "label": pa.array([value], pa.int64()), "part": pa.array([part], pa.int32()),
                    "ids": pa.array([ids[at].tobytes()], pa.binary()), "flat": pa.array([narrowed(q[at]).tobytes()], pa.binary()),
                })

    dealt = rows.repartitionByRange(slabs, "label", F.col("q")[int(axes[0])], F.xxhash64("id", "q")).withColumn("slab", F.spark_partition_id())
    return dealt.select("slab", "label", "id", "q").mapInArrow(run, "slab int, label long, part int, ids binary, flat binary")


def _visit(trees: DataFrame, sent: DataFrame, d: int, k: int, same: bool, keys: int, kind: type) -> DataFrame:
    """(anchor, w, score, id): of each slab the k best rows of each anchor's windows, in trees of its own label or of all others.

    ``sent`` has (slab, anchor, id, label, q, windows); windows are pairs (from, to), null stands for
    a single open one. A task reads the trees of a slab, then its anchors as they come.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, built = None, {}, {}
        for part in parts:
            numbers, kinds = part.column("visit").to_numpy(), part.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), part.num_rows]
            for start, end in zip(edges, edges[1:]):
                run_of = part.slice(start, end - start)
                if numbers[start] != now:
                    now, held, built = numbers[start], {}, {}
                if kinds[start] == 0:
                    for label, ids, flat in zip(*(run_of.column(c).to_pylist() for c in ("label", "ids", "flat"))):
                        held.setdefault(label, []).append(_tile(ids, flat, d))
                    continue
                if held:
                    built = {label: Tree(np.concatenate([i for i, _ in x]), np.concatenate([q.astype(kind) for _, q in x])) for label, x in held.items()}
                    held = {}
                for j in range(0, run_of.num_rows, BLOCK):
                    yield from answers(built, run_of.slice(j, BLOCK))

    def answers(built: dict, block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, label = block.column("id").to_numpy(), block.column("label").to_numpy()
        q = _matrix(block.column("q")).astype(kind)
        open_, shut = (-math.inf, math.inf), (math.inf, -math.inf)
        windows = [[open_] if w is None else [tuple(x) for x in w] for w in block.column("windows").to_pylist()]
        width = max(map(len, windows))
        best = Best(np.array([w + [shut] * (width - len(w)) for w in windows], kind), k)
        for value, tree in built.items():
            who = np.flatnonzero((label == value) == same)
            if len(who):
                search(tree, q, own, best, who)
        anchor = block.column("anchor").to_pylist()
        out = [(anchor[i], w, -s, n) for i, each in enumerate(best.found) for w, x in enumerate(each) for s, n in x]
        if out:
            keys, at, scores, ids = zip(*out)
            whole = [int(s) if abs(s) < 2**63 else None for s in scores]
            yield pa.record_batch({"anchor": pa.array(keys, pa.int64()), "w": pa.array(at, pa.int32()), "score": pa.array(whole, pa.int64()), "id": pa.array(ids, pa.int64())})

    t = trees.withColumn("kind", F.lit(0))
    s = sent.withColumn("kind", F.lit(1))
    both = t.unionByName(s, allowMissingColumns=True).select("visit", "kind", "label", "part", "ids", "flat", "anchor", "id", "q", "windows")
    both = both.repartition(keys, "visit").sortWithinPartitions("visit", "kind", "label", "part", "anchor")
    return both.mapInArrow(run, "anchor long, w int, score long, id long")


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, id_column: str = "vec_id", label: str = "label", vector: str = "embedding", anchor_every: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``anchor_every``. A negative scores at most as much
    as the positive, and at least ``low`` hundredths of that.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    good = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v") & ~F.exists("v", lambda c: F.abs(c) >= 2.0**53 / scale))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    d = usual_length(good, "v")
    if not d:
        return spark.createDataFrame([], out)
    points = good.where(F.size("v") == d).select("id", "label", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("q"))
    points = materialize(points, "points")
    n, most = points.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("q", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], out)
    kind = float if 100 * most * most * d < 2**53 else object
    slabs = math.ceil(n / min(LARGEST_SLAB, max(LEAF, int(SLAB * math.sqrt(n)))))
    trees = materialize(pack(points, d, slabs), "trees")
    anchors = points.where(F.pmod("id", F.lit(anchor_every)) == 0).distinct().withColumn("anchor", F.xxhash64("id", "label", "q"))
    anchors = materialize(anchors, "anchors")
    # each share of the anchors meets its own copy of a slab
    shares = math.ceil(anchors.count() / VISITORS)
    slabs = (trees.agg(F.max("slab")).first()[0] or 0) + 1
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.lit(max(k, 1) - 1)))
    held = trees.withColumn("share", upto(shares)).withColumn("visit", F.col("slab") * max(shares, 1) + F.col("share")).drop("share")
    goes = (F.col("slab") * max(shares, 1) + F.pmod("anchor", F.lit(max(shares, 1)))).cast("int").alias("visit")
    visit = lambda sent, k, same: _visit(held, sent.withColumn("visit", goes), d, k, same, slabs * max(shares, 1), kind)
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    places = trees.select("label", "slab").distinct()
    found = visit(anchors.join(places, "label").withColumn("windows", F.lit(None).cast("array<array<long>>")), positives, True)
    near = found.withColumn("rank", F.row_number().over(best("anchor"))).where(F.col("rank") <= positives)
    near = materialize(near.select("anchor", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # as whole numbers: low x positive <= 100 x negative <= 100 x positive
    score = F.col("positive_score")
    window = F.array(F.ceil(score.cast("decimal(24,0)") * low / 100).cast("long"), score)
    windows = near.where(score.isNotNull()).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("w", window.alias("x")))).alias("w"))
    windows = windows.select("anchor", F.transform("w", lambda w: w["x"]).alias("windows"))
    far = visit(anchors.join(windows, "anchor").withColumn("slab", upto(slabs)), negatives, False)
    ranked = far.withColumn("rank", F.row_number().over(best("anchor", "w"))).where(F.col("rank") <= negatives)
    pairs = ranked.select("anchor", (F.col("w") + 1).alias("w"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return pairs.join(near, ["anchor", "w"]).join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
