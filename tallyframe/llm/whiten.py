"""Whitening of embeddings by QDWH spectral divide and conquer.

Each vector entry ``c`` becomes the whole number ``x = floor(64 c) + 1000000``. The covariance of
the distinct x-vectors is summed task by task about their exact mean; the driver, which holds no
more than matrices of the dimension squared, splits its space: the polar factor of the covariance
less a shift is the sign of each direction, (U + I) / 2 projects on the directions above the shift,
and both halves are split again until single components remain. The matrix of the leading
components is broadcast and the rows are projected in batches.

Rows whose vector is null, empty, or has null or non-finite entries, or entries whose x has no long,
take no part. Where lengths differ, the length that most rows have counts (the longer on a tie);
other rows take no part. Repeated rows come out as often as they came in, null ids as null. A
component without variance has null for ``whitened`` and isn't part of ``identity_error``; without
any variance ``explained`` is null, too. ``deviation`` is null where it has no long. Without rows
there is no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries from here on have no exact x.
LARGEST = float(2**53)
#: Rows of a batch that a task works on at once.
ROWS = 4096
EPS = np.finfo(float).eps


def usable(vector: str) -> Column:
    """Whether a row's vector is there and has finite entries."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def whole_numbers(vector: str) -> Column:
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usual_length(rows: DataFrame, vector: str) -> int:
    """The length that most rows have; 0 without rows."""
    best = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return best["d"] if best else 0


# -- the covariance, by task -------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for k in range(0, part.num_rows, ROWS):
            yield part.slice(k, ROWS)


def _sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums by dimension of a task, as exact numbers."""
    n, total = 0, None
    for part in _batches(parts):
        x = _matrix(part.column("x"))
        safe = np.abs(x).max() < 2**62 // ROWS
        own = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
        total = [int(v) for v in own] if total is None else [a + int(b) for a, b in zip(total, own)]
        n += len(x)
    if n:
        yield pa.record_batch({"j": pa.array(range(len(total)), pa.int32()), "s": pa.array([str(v) for v in total]), "n": pa.array([n] * len(total), pa.int64())})


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n x - S exactly, and x - S / n from it."""
    wide = max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, sums)) if x.size else 0
    if wide < 2**62:
        top = x * n - np.array(sums, np.int64)
        return top, top / n
    top = x.astype(object) * n - np.array(sums, object)
    return top, np.array([[float(v) for v in row] for row in top]) / n


def deviations(top: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null where a long can't hold one."""
    if top.dtype != object and (not top.size or int(np.abs(top).max()) ** 2 * top.shape[1] < 2**63):
        return (top * top).sum(axis=1).tolist()
    squares = [sum(int(v) ** 2 for v in row) for row in top]
    return [s if s < 2**63 else None for s in squares]


def _gram(fit: DataFrame, d: int, values) -> np.ndarray:
    """Sum over the rows of v v', where ``values`` gives a batch's v: each task hands on one matrix, and those are summed entry by entry."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        seen = False
        for part in _batches(parts):
            v = values(_matrix(part.column("x")))
            total += v.T @ v
            seen = True
        if seen:
            for i in range(d):
                yield pa.record_batch({"i": pa.array([i] * d, pa.int32()), "j": pa.array(range(d), pa.int32()), "v": pa.array(total[i])})

    got = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # d x d entries
    out = np.zeros((d, d))
    for r in got:
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


# -- QDWH ----------------------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps: by QR while it is badly scaled, then by Cholesky."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)  # the Frobenius norm bounds the spectral one
    low, eye = EPS, np.eye(n)
    for _ in range(40):
        root = np.cbrt(4 * (1 - low * low) / low**4)
        h = np.sqrt(1 + root) + np.sqrt(8 - 4 * root + 8 * (2 - low * low) / (low * low * np.sqrt(1 + root))) / 2
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
            new = b / c * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            w = np.linalg.cholesky(eye + c * (x.T @ x))
            y = np.linalg.solve(w, x.T)
            new = b / c * x + (h - b / c) * np.linalg.solve(w.T, y).T
        low = min(1.0, low * (h + b * low * low) / (1 + c * low * low))
        moved = np.linalg.norm(new - x)
        x = (new + new.T) / 2
        if moved <= np.cbrt(EPS) and 1 - low < 1e-10:
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the directions above ``shift``; None where that doesn't cut the space in two."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < n:
        return None
    # the columns that weigh most begin the basis; a second pass with the projector makes it exact
    order = np.argsort(-np.diag(projector), kind="stable")
    q, _ = np.linalg.qr(projector[:, order])
    first, _ = np.linalg.qr(projector @ _leading(projector, q, k))
    rest, _ = np.linalg.qr(np.hstack([first, np.eye(n)[:, np.argsort((first**2).sum(axis=1), kind="stable")]]))
    basis = rest[:, :n]
    basis[:, :k] = first
    off = np.linalg.norm(basis[:, :k].T @ a @ basis[:, k:])
    return (basis, k) if off <= 1e3 * n * EPS * np.linalg.norm(a) else None


def _leading(projector: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """k independent columns of the projector's range: Cholesky with pivots picks them."""
    left = projector.copy()
    picked = []
    for _ in range(k):
        p = int(np.argmax(np.diag(left)))
        picked.append(p)
        left = left - np.outer(left[:, p], left[p]) / max(left[p, p], EPS)
    return projector[:, picked]


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns. Deterministic; equal eigenvalues have some orthonormal basis of their space."""
    n = len(a)
    scale = np.linalg.norm(a)
    values, vectors = np.zeros(n), np.zeros((n, n))
    work, at = [(a, np.eye(n))], 0
    while work:
        block, basis = work.pop()
        m = len(block)
        off = np.linalg.norm(block - np.diag(np.diag(block)))
        if m == 1 or off <= EPS * scale:
            order = np.argsort(-np.diag(block), kind="stable")
            for k in order:
                values[at], vectors[:, at] = block[k, k], basis[:, k]
                at += 1
            continue
        cut = None
        spread = np.sqrt(max(np.linalg.norm(block) ** 2 / m - (np.trace(block) / m) ** 2, 0.0))
        for shift in (np.median(np.diag(block)), np.trace(block) / m, *(np.trace(block) / m + f * spread for f in (0.31, -0.31, 0.77, -0.77, 0.05, -0.05))):
            if cut := _split(block, float(shift)):
                break
        if cut is None:  # nothing parts these to double precision but rotations in pairs
            block, turn = _rotated(block)
            work.append((np.diag(np.diag(block)), basis @ turn))
            continue
        own, k = cut
        high, low = own[:, :k], own[:, k:]
        halves = [(h.T @ block @ h, basis @ h) for h in (low, high)]
        work += [((b + b.T) / 2, v) for b, v in halves]  # the upper half is popped first
    order = np.argsort(-values, kind="stable")
    return refined(a, vectors[:, order])


def _rotated(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jacobi sweeps over a block whose eigenvalues are too near to each other for a shift between them."""
    a, turn, m = block.copy(), np.eye(len(block)), len(block)
    for _ in range(30):
        if np.linalg.norm(a - np.diag(np.diag(a))) <= EPS * np.linalg.norm(block):
            break
        for p in range(m - 1):
            for q in range(p + 1, m):
                if abs(a[p, q]) > np.finfo(float).tiny:
                    t = (a[q, q] - a[p, p]) / (2 * a[p, q])
                    t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(1.0, t))
                    c = 1 / np.hypot(1.0, t)
                    g = np.array([[c, t * c], [-t * c, c]])
                    a[:, [p, q]] = a[:, [p, q]] @ g
                    a[[p, q]] = g.T @ a[[p, q]]
                    turn[:, [p, q]] = turn[:, [p, q]] @ g
    return a, turn


def refined(a: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A correction of all pairs at once, quadratic in what splitting has left; pairs too near to part keep their basis, and the whole is made orthonormal."""
    eye = np.eye(len(a))
    r = eye - vectors.T @ vectors
    s = vectors.T @ a @ vectors
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None, :] - values[:, None]
    close = 1e-7 * np.abs(gap) <= np.abs(s - np.diag(np.diag(s))) + EPS * np.linalg.norm(a)
    vectors = vectors + vectors @ np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1.0, gap))
    vectors = vectors @ (3 * eye - vectors.T @ vectors) / 2
    values = (vectors * (a @ vectors)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# -- the operator ----------------------------------------------------------------------------------


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and leading component."""
    spark = rows.sparkSession
    kind = rows.schema[id_column].dataType.simpleString()
    out = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = rows.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).where(usable("v"))
    d = usual_length(good, "v")
    if not d:
        return spark.createDataFrame([], out)
    x = good.where(F.size("v") == d).select("id", whole_numbers("v").alias("x"))
    fit = materialize(x.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    sums = fit.mapInArrow(_sums, "j int, s string, n long").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("j").collect()
    n, total = sums[0]["n"], [int(r["s"]) for r in sums]
    cov = _gram(fit, d, lambda m: centred(m, n, total)[1]) / n
    values, vectors = spectral_components(cov)
    trace, top = float(np.trace(cov)), min(components, d)
    live = values[:top] > d * EPS * max(float(values[0]), 0.0)
    shape = np.where(live, vectors[:, :top] / np.sqrt(np.where(live, values[:top], 1.0)), 0.0)
    held = spark.sparkContext.broadcast((n, total, shape))  # d x components numbers and d sums
    after = _gram(fit, top, lambda m: centred(m, n, total)[1] @ held.value[2]) / n
    kept = np.flatnonzero(live)
    error = float(np.abs(after[np.ix_(kept, kept)] - np.eye(len(kept))).max()) if len(kept) else None

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, shape = held.value
        for part in _batches(parts):
            exact, plain = centred(_matrix(part.column("x")), n, total)
            white = plain @ shape
            flat = pa.array(white.ravel())
            offsets = pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32())
            yield pa.record_batch({"id": part.column("id"), "deviation": pa.array(deviations(exact), pa.int64()), "w": pa.ListArray.from_arrays(offsets, flat)})

    white = x.mapInArrow(project, f"id {kind}, deviation long, w array<double>")
    number = F.posexplode("w").alias("at", "whitened")
    one = lambda flags, v: F.element_at(F.array(*[F.lit(float(a)) if ok else F.lit(None).cast("double") for ok, a in zip(flags, v)]), F.col("at") + 1)
    there = [trace > 0] * top
    y = white.select("id", "deviation", number)
    return y.select(
        "id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.element_at(F.array(*[F.lit(bool(f)) for f in live]), F.col("at") + 1), F.col("whitened")).alias("whitened"),
        one(there, values[:top] / trace if trace > 0 else values[:top]).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
