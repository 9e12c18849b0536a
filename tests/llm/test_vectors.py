"""Whitening and hard negatives against plain numpy, on the table and on awkward rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import hard_negatives, queries, whiten

from ..conftest import SMALL

NAN, INF = float("nan"), float("inf")
AWKWARD = [
    (1, [1.0, 2.0, 3.0], 1), (2, None, 1), (3, [], 1), (4, [1.0, None, 2.0], 1), (5, [NAN, 1.0, 2.0], 1), (6, [INF, 1.0, 1.0], 2), (7, [1e300, 1.0, 1.0], 2), (9, [1.0, 2.0], 2),
    (None, [1.0, 2.0, 3.0], 2), (1, [1.0, 2.0, 3.0], 1), (10, [5.0, 5.0, 5.0], None), (11, [-2.5, 7.0, 0.1], 2), (12, [0.0, 0.0, 1.0], 1), (12, [0.0, 0.0, 1.0], 1),
]


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    return df.withColumns({"x": F.lit(1), "component": F.lit("clash"), "slab": F.lit(2.0), "anchor": F.lit(None)})


# -- whitening


MATRICES = {
    "random": lambda n, g: (lambda x: x.T @ x)(g.normal(size=(5 * n, n))), "identity": lambda n, g: 3 * np.eye(n), "zero": lambda n, g: np.zeros((n, n)),
    "low rank": lambda n, g: (lambda x: x.T @ x)(g.normal(size=(3, n))), "repeated": lambda n, g: np.ones((n, n)) + np.eye(n) / 2,
    "graded": lambda n, g: (lambda q: q * 2.0 ** -np.arange(n) @ q.T)(np.linalg.qr(g.normal(size=(n, n)))[0]),
    "near": lambda n, g: (lambda q: q * (1 + 1e-13 * np.arange(n)) @ q.T)(np.linalg.qr(g.normal(size=(n, n)))[0]),
}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", MATRICES)
def test_components_to_double_precision(kind, n):
    a = MATRICES[kind](n, np.random.default_rng(n))
    a = (a + a.T) / 2
    values, q = whiten.spectral_components(a)
    size = np.linalg.norm(a, 2) or 1.0
    assert np.abs(a @ q - q * values).max() <= 1e-14 * size and np.abs(q.T @ q - np.eye(n)).max() <= 1e-14
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * size * max(n, 4)
    assert (np.diff(values) <= 1e-15 * size).all()


def test_polar_factor():
    a = np.diag([3.0, -1e-9, 2.0, -5.0])
    assert np.abs(whiten.polar(a) - np.diag([1.0, -1, 1, -1])).max() < 1e-12


def plain_whitening(rows):
    """By the definition, in whole numbers where it asks for them; eigenvectors by LAPACK."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    cov = z.T @ z / n
    values, q = np.linalg.eigh(cov)
    values, q = values[::-1], q[:, ::-1]
    out = {}
    for i, x in kept:
        top = [n * c - s for c, s in zip(x, sums)]
        out[i] = sum(t * t for t in top), (np.array(top) / n) @ q[:, :16] / np.sqrt(values[:16])
    return n, values / values.sum(), out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_whitening_query(spark, sf):
    got = queries.op12_whitening(spark, SMALL.replace("sf0.001", sf)).toPandas()
    rows = spark.read.parquet(SMALL.replace("sf0.001", sf) + "/embeddings.parquet").select("vec_id", "embedding").collect()
    n, shares, want = plain_whitening(rows)
    assert len(got) == 16 * len(rows) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-12
    white = got.pivot(index="vec_id", columns="component", values="whitened")
    ids = list(want)
    a, b = white.loc[ids].to_numpy(), np.array([want[i][1] for i in ids])
    assert np.abs(a * np.sign((a * b).sum(axis=0)) - b).max() < 1e-9
    assert np.abs(got.groupby("component")["explained"].first().to_numpy() / shares[:16] - 1).max() < 1e-10
    assert got.groupby("vec_id")["deviation"].first().loc[ids].tolist() == [want[i][0] for i in ids]


def test_whitening_awkward(spark):
    got = whiten.whiten(vectors(spark, AWKWARD)).collect()
    assert sorted(str(r["id"]) for r in got) == sorted(str(i) for i in (1, None, 1, 10, 11, 12, 12) for _ in range(3))
    assert {r["n"] for r in got} == {4} and all(r["identity_error"] < 1e-12 for r in got)
    alike = [sorted((r["component"], r["whitened"], r["deviation"]) for r in got if r["id"] == i) for i in (1, None)]
    assert sorted(alike[1] * 2) == alike[0]


def test_whitening_without_variance(spark):
    one = whiten.whiten(vectors(spark, AWKWARD[:1])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 3
    flat = whiten.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [2.0, 2.0], 0)])).collect()
    assert sorted((r["id"], r["component"], None if r["whitened"] is None else abs(r["whitened"])) for r in flat) == [(1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None)]
    for rows in (AWKWARD[1:3], []):
        assert whiten.whiten(vectors(spark, rows)).count() == 0


def test_whitening_of_large_entries(spark):
    """Sums and squares are exact beyond what a long or a double holds."""
    rows = [(1, [1e12, 2.0], 0), (2, [-3e13, 1.0], 0), (3, [7e11, 5.0], 0)]
    got = {(r["id"], r["component"]): r for r in whiten.whiten(vectors(spark, rows)).collect()}
    n, _, want = plain_whitening([(i, v) for i, v, _ in rows])
    assert all(got[i, 1]["deviation"] is None and want[i][0] >= 2**63 for i in (1, 2, 3))
    assert all(abs(abs(got[i, 1]["whitened"]) - abs(want[i][1][0])) < 1e-9 for i in (1, 2, 3))


# -- hard negatives


def plain_negatives(rows):
    """(id, vector, label), by the definition; equal anchor rows count once."""
    usable = [(i, [math.floor(256 * c) for c in v], y) for i, v, y in rows if i is not None and y is not None and v and all(c is not None and math.isfinite(c) and abs(c) < 2**45 for c in v)]
    sizes = [len(v) for _, v, _ in usable]
    usual = max(set(sizes), key=lambda d: (sizes.count(d), d), default=0)
    usable = [(i, tuple(v), y) for i, v, y in usable if len(v) == usual]
    out = []
    for i, v, y in {r for r in usable if r[0] % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in usable if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            fits = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, k + 1, m, -s, -t) for k, (t, m, _) in enumerate(fits)]
    return sorted(out)


def mined(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in hard_negatives.mine(df).collect())


def test_negatives_query(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END FROM embeddings").fetchall()
    got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in queries.op13_hard_negatives(spark, SMALL).collect())
    assert got == plain_negatives(rows)


def test_negatives_with_ties_copies_and_a_hot_vector(spark):
    g = np.random.default_rng(5)
    base = g.integers(-3, 4, size=(40, 6)) / 4
    rows = [(k, [float(c) for c in base[k % 40 if k % 3 else 0]], int(k % 4)) for k in range(1500)]
    rows += rows[:300:50] + [(100, rows[7][1], 3)]
    assert mined(vectors(spark, rows)) == plain_negatives(rows)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e9])
def test_negatives_of_any_size_are_exact(spark, scale):
    g = np.random.default_rng(6)
    rows = [(k * 20, [float(c) for c in g.normal(size=5) * scale], int(k % 3)) for k in range(400)]
    got, want = mined(vectors(spark, rows)), plain_negatives(rows)
    whole = lambda r: r[4] < 2**63
    assert got == [r for r in want if whole(r)] and got or not any(map(whole, want))


def test_negatives_awkward(spark):
    rows = [(None if i is None else i * 100, v, y) for i, v, y in AWKWARD]
    assert mined(vectors(spark, rows)) == plain_negatives(rows)
    for rows in (AWKWARD[1:3], [], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (200, [0.9], 2)]):
        assert mined(vectors(spark, rows)) == []


def test_boxes_bound_every_product():
    g = np.random.default_rng(7)
    q = g.integers(-50, 50, size=(3000, 8)).astype(float)
    q = q[hard_negatives.tiled(q, np.arange(8))]
    tree = hard_negatives.Tree(np.arange(3000), q)
    a = g.integers(-50, 50, size=(9, 8)).astype(float)
    for level in range(len(tree.levels)):
        least, most = tree.bounds(level, 0, len(tree.levels[level][0]), a)
        step = hard_negatives.LEAF * hard_negatives.FANOUT**level
        for k in range(least.shape[1]):
            s = a @ q[k * step : (k + 1) * step].T
            assert (least[:, k] <= s.min(axis=1)).all() and (most[:, k] >= s.max(axis=1)).all()
