"""The line field: whole chains in training, long texts, and labels of lines that differ from their document's."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import line_crf

GOOD = "The quick brown foxes went over the hills and came home before the evening was done."
BAD = "$$$ 88% *** CLICK 00 ## <<>> 77 {} == || 4 4 4 4"


@pytest.mark.parametrize("sizes", [[7, 1, 20, 3, 9], [50], [6, 7], [1, 1], [64, 2, 200]])
def test_long_chains_in_pieces_are_exact(monkeypatch, sizes):
    g = np.random.default_rng(len(sizes))
    sizes = np.array(sizes)
    unary, pair = 3 * g.normal(size=(sizes.sum(), 2)), g.normal(size=(2, 2))
    monkeypatch.setattr(line_crf, "PIECE", 10_000)
    whole = line_crf.forward_backward(unary, pair, sizes)
    for piece in (1, 2, 3, 8):
        monkeypatch.setattr(line_crf, "PIECE", piece)
        for a, b in zip(whole, line_crf.forward_backward(unary, pair, sizes)):
            assert np.abs(a - b).max() < 1e-9


def mixed(n: int, seed: int):
    """Good documents with a few bad lines and bad ones with a few good lines, in runs."""
    g = np.random.default_rng(seed)
    texts, labels, lines = [], [], []
    for k in range(n):
        y = int(g.random() < 0.6)
        own = [y] * int(g.integers(8, 15)) + [1 - y] * int(g.integers(0, 3))
        if g.random() < 0.5:
            own = own[::-1]
        texts.append("\n".join(f"{GOOD if s else BAD} {g.integers(1000)}" for s in own))
        labels.append(y)
        lines.append(own)
    return texts, np.array(labels, float), lines


def test_hidden_lines_are_told_apart():
    texts, labels, lines = mixed(200, 1)
    field = line_crf.fit(texts, labels)
    more, _, want = mixed(100, 2)
    x, _, sizes = line_crf.line_features(more)
    u = line_crf.with_neighbours(x, sizes) @ field.weights
    good = line_crf.marginals(np.stack([np.zeros_like(u), u], 1), field.pair, sizes) > 0.5
    assert (good == np.concatenate(want).astype(bool)).mean() > 0.95
    assert np.allclose(field.score(more) > 0.5, [np.mean(w) > 0.5 for w in want])


def test_a_huge_text_doesnt_switch_the_learner_off(spark):
    texts, labels, _ = mixed(40, 3)
    rows = [(k, t) for k, t in enumerate(texts)] + [(k, GOOD * 2000) for k in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    marks = spark.createDataFrame([(k, int(y)) for k, y in enumerate(labels)] + [(k, 1) for k in range(100, 140)], "doc_id long, quality int")
    bound = sum(map(len, texts)) + 1000  # no long text fits
    field = line_crf.learn(docs, marks, max_bytes=bound)
    plain = line_crf.learn(docs.where("doc_id < 100"), marks.where("doc_id < 100"))
    assert np.abs(field.weights).max() > 0.1 and np.allclose(field.weights, plain.weights)
    got = line_crf.score(docs, marks, field=field)
    assert got.count() == 80 and got.where(F.col("doc_id") >= 100).agg(F.min("score")).first()[0] > 0.5


def test_long_labelled_texts_train_whole():
    """One line in the middle of thousands counts: nothing is cut off."""
    texts, labels, _ = mixed(40, 4)
    long = "\n".join([GOOD] * 3000)
    a = line_crf.fit(texts + [long], np.append(labels, 1.0))
    b = line_crf.fit(texts + [long + ("\n" + BAD) * 500], np.append(labels, 1.0))
    assert not np.allclose(a.weights, b.weights, atol=1e-4)
