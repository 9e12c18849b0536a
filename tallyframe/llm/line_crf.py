"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line with a word is good or bad. Its potentials come from its own features and its two
neighbours'; a transition matrix ties lines together. Training starts with each labelled document's
label on all its lines. Then the lines' labels are taken as hidden: of the lines' joint distribution
under the field the nearest one is taken in which the length-weighted share of good lines is at least
``SHARE`` in a good document and at most 1 - ``SHARE`` in a bad one, and the field is fitted to that,
in turns; the first turn starts from a fit of single lines. So a good document may hold bad lines, and the transitions are learnt from chains that
change state. Forward-backward marginals, weighted by line length, give the share of good text, and
a logistic curve fitted on the training documents turns it into a score.

Training takes whole texts. Of the labelled documents that a hash draws, texts of up to
``LONG_BYTES`` come first and longer ones by size, as many as ``SAMPLE_BYTES`` hold; a text over
that is passed over, not those behind it.

Texts without words (null, empty, blank) are scored as one line without words. Repeated rows
get equal scores. Without usable labels, or with one class only, every score is the share of
label 1 (0.5 without any). Only text reaches the features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents (about) that the field is fitted on.
SAMPLE_DOCUMENTS = 4_000
#: Bytes of their texts that the driver takes at most.
SAMPLE_BYTES = 64 << 20
#: Longer texts are drawn after all others.
LONG_BYTES = 1 << 20
#: Lines that a message walks through one by one; longer chains are joined piece by piece.
PIECE = 64
#: Share of a document's text, by length, that has its label at least.
SHARE = 0.8
N_LINE = 14

_KINDS = np.zeros((6, 256), np.uint8)
_KINDS[0, [9, 10, 11, 12, 13, 32]] = 1  # spaces
_KINDS[1, 65:91] = 1  # capitals
_KINDS[2, 48:58] = 1  # digits
_KINDS[3, [ord(c) for c in "#*$%&<>|=_~^{}[]\\/@+"]] = 1  # symbols
_KINDS[4, [33, 63]] = 1  # ! and ?
_KINDS[5, 128:192] = 1  # bytes that go on with a character


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, weight of each line, lines of each text) over all texts."""
    lines: list[bytes] = []
    sizes, distinct, repeated, ended, same = [], [], [], [], []
    for text in texts:
        own = [x for x in (text or "").encode().split(b"\n") if not x.isspace() and x] or [b""]
        seen: set[bytes] = set()
        for x in own:
            w = x.split()
            distinct.append(len(set(w)))
            repeated.append(sum(map(bytes.__eq__, w, w[1:])))
            ended.append(w[-1][-1:] in b".!?:\"')" if w else False)
            same.append(x in seen)
            seen.add(x)
        lines += own
        sizes.append(len(own))
    a = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    ends = np.flatnonzero(a == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = lambda flags: np.add.reduceat(flags.astype(np.int32), starts).astype(float)
    space = _KINDS[0][a].astype(bool)
    words = count(np.concatenate(([~space[0]], ~space[1:] & space[:-1])))
    upper, digit, symbol, mark, inner = (count(_KINDS[k][a]) for k in range(1, 6))
    chars = count(~space) - inner
    n, c = np.maximum(words, 1), np.maximum(chars, 1)
    length = chars / n
    x = np.stack([
        np.ones(len(n)), np.log1p(words) / 5, np.clip(length - 5.5, 0, 4), np.clip(4.5 - length, 0, 4), np.clip(symbol / n, 0, 2),
        np.clip(upper / c, 0, 1) * 2, np.clip(mark / n, 0, 2), np.clip(digit / c, 0, 1) * 2, 1 - np.array(distinct) / n,
        np.array(repeated) / n * 2, np.array(ended, float), np.array(same, float), (words < 4).astype(float), (words > 120).astype(float),
    ], 1)
    return x, np.maximum(chars, 1), np.array(sizes)


def with_neighbours(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Own features, then the line's before and after; zeros beyond the text's ends."""
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    before, after = np.vstack([np.zeros((1, x.shape[1])), x[:-1]]), np.vstack([x[1:], np.zeros((1, x.shape[1]))])
    before[first] = 0
    after[first + sizes - 1] = 0
    return np.hstack([x, before, after])


def _steps(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Chains by falling length, where each begins, and how many reach step t."""
    order = np.argsort(-sizes, kind="stable")
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))[order]
    reach = np.cumsum(np.bincount(sizes, minlength=sizes.max() + 1)[::-1])[::-1]
    return order, first, [int(reach[t + 1]) for t in range(sizes.max())]


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(exp a + exp b) for two columns of states."""
    m = np.maximum(a, b)
    return m + np.log1p(np.exp(-np.abs(a - b)))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log message through a transfer: a[.., r] and b[.., r, s] to [.., s]."""
    return _add(a[..., 0, None] + b[..., 0, :], a[..., 1, None] + b[..., 1, :])


def _forward(unary: np.ndarray, pair: np.ndarray, sizes: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Log forward messages; ``start`` is each chain's message before its first line, NaN where nothing is before it."""
    order, first, reach = _steps(sizes)
    alpha = unary.copy()
    if start is not None:
        entered = _join(start[order], pair)
        alpha[first] += np.where(np.isnan(entered), 0.0, entered)
    for t in range(1, len(reach)):
        at = first[: reach[t]] + t
        alpha[at] += _join(alpha[at - 1], pair)
    return alpha


def _backward(unary: np.ndarray, pair: np.ndarray, sizes: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
    """Log backward messages; ``end`` is that of each chain's last line."""
    order, first, reach = _steps(sizes)
    beta = np.zeros_like(unary)
    if end is not None:
        beta[first + sizes[order] - 1] = end[order]
    for t in range(len(reach) - 2, -1, -1):
        at = first[: reach[t + 1]] + t
        beta[at] = _join(beta[at + 1] + unary[at + 1], pair.T)
    return beta


def forward_backward(unary: np.ndarray, pair: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward messages by line and the log partition by chain, all chains at once.

    Chains over ``PIECE`` lines are cut into pieces: the transfer through each piece is worked out
    for both states before it, the transfers are chained, and then every piece gets its messages.
    This is exact, and the steps are PIECE and the number of pieces instead of the number of lines.
    """
    if sizes.max() <= 2 * PIECE:
        alpha, beta = _forward(unary, pair, sizes), _backward(unary, pair, sizes)
    else:
        n_pieces = -(-sizes // PIECE)
        pieces = np.full(n_pieces.sum(), PIECE)
        pieces[np.cumsum(n_pieces) - 1] = sizes - PIECE * (n_pieces - 1)
        last = np.cumsum(pieces) - 1
        before = np.where(np.eye(2, dtype=bool), 0.0, -1e300)  # one state or the other for certain
        through = np.stack([_forward(unary, pair, pieces, np.tile(b, (len(pieces), 1)))[last] for b in before], 1)
        opening = _forward(unary, pair, pieces)[last]  # counts for first pieces alone
        enter, leave = np.full((len(pieces), 2), np.nan), np.zeros((len(pieces), 2))
        order, first, reach = _steps(n_pieces)
        carried = opening.copy()
        for t in range(1, len(reach)):
            at = first[: reach[t]] + t
            enter[at] = carried[at - 1]
            carried[at] = _join(carried[at - 1], through[at])
        for t in range(len(reach) - 2, -1, -1):
            at = first[: reach[t + 1]] + t
            leave[at] = _join(leave[at + 1], through[at + 1].transpose(0, 2, 1))
        alpha, beta = _forward(unary, pair, pieces, enter), _backward(unary, pair, pieces, leave)
    last = np.cumsum(sizes) - 1
    return alpha, beta, np.repeat(_add(alpha[last, 0], alpha[last, 1]), sizes)


def marginals(unary: np.ndarray, pair: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Probability of state 1 by line."""
    alpha, beta, z = forward_backward(unary, pair, sizes)
    return np.exp(alpha[:, 1] + beta[:, 1] - z)


@dataclass
class LineField:
    weights: np.ndarray  # of state 1 against state 0
    pair: np.ndarray
    slope: float
    offset: float

    def share(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of being good."""
        x, weight, sizes = line_features(texts)
        u = with_neighbours(x, sizes) @ self.weights
        good = marginals(np.stack([np.zeros_like(u), u], 1), self.pair, sizes)
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        m = np.clip(self.share(texts), 1e-6, 1 - 1e-6) if self.slope else np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(m / (1 - m)) + self.offset, -30, 30)))


def _adam(grad, theta: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = grad(theta)
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
    return theta


@dataclass
class _Chains:
    """The training documents' lines, and what the field expects of them."""

    x: np.ndarray
    sizes: np.ndarray
    weight: np.ndarray  # of each line in its document's share, summing to 1 a document
    balance: np.ndarray  # of each document

    def __post_init__(self):
        last = np.cumsum(self.sizes) - 1
        inner = np.ones(len(self.x), bool)
        inner[last] = False
        self.at = np.flatnonzero(inner)
        self.first = np.concatenate(([0], last[:-1] + 1))
        self.line_w = np.repeat(self.balance / self.sizes, self.sizes)

    def expect(self, u: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of being good by line, and the weighted number of each transition."""
        unary, at = np.stack([np.zeros_like(u), u], 1), self.at
        alpha, beta, z = forward_backward(unary, pair, self.sizes)
        joint = lambda s, r: np.exp(alpha[at, s] + pair[s, r] + unary[at + 1, r] + beta[at + 1, r] - z[at])
        moves = np.array([[(self.line_w[at] * joint(s, r)).sum() for r in (0, 1)] for s in (0, 1)])
        return np.exp(alpha[:, 1] + beta[:, 1] - z), moves

    def shares(self, u: np.ndarray, pair: np.ndarray) -> np.ndarray:
        good = marginals(np.stack([np.zeros_like(u), u], 1), pair, self.sizes)
        return np.add.reduceat(good * self.weight, self.first)

    def held_to(self, quality: np.ndarray, u: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Potentials of the nearest distribution with enough of each document in its label: its lines lean that way by one amount each, found by halving."""
        sign = np.where(quality == 1, 1.0, -1.0)
        short = lambda lean: sign * (self.shares(u + np.repeat(sign * lean, self.sizes) * self.weight * np.repeat(self.sizes, self.sizes), pair) - 0.5) < SHARE - 0.5
        low, high = np.zeros(len(quality)), np.full(len(quality), 64.0)
        ask = short(low)
        for _ in range(14):
            middle = (low + high) / 2
            less = short(middle)
            low, high = np.where(less, middle, low), np.where(less, high, middle)
        return u + np.repeat(sign * np.where(ask, high, 0.0), self.sizes) * self.weight * np.repeat(self.sizes, self.sizes)


def fit(texts: list[str | None], quality: np.ndarray, steps: int = 200, turns: int = 4, rate: float = 0.05, decay: float = 1e-3) -> LineField:
    """Conditional likelihood by Adam, classes balanced; then hidden labels in turns; then the logistic curve."""
    share = (quality.sum() + 0.5) / (len(quality) + 1) if len(quality) else 0.5
    plain = LineField(np.zeros(3 * N_LINE), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    if len(quality) == 0 or quality.min() == quality.max():
        return plain
    x, weight, sizes = line_features(texts)
    balance = np.where(quality == 1, 0.5 / max(1, quality.sum()), 0.5 / max(1, (1 - quality).sum()))
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    chains = _Chains(with_neighbours(x, sizes), sizes, weight / np.repeat(np.add.reduceat(weight, first), sizes), balance)

    def towards(good: np.ndarray, moves: np.ndarray):
        def grad(both: np.ndarray) -> np.ndarray:
            theta, pair = both[:-4], both[-4:].reshape(2, 2)
            now, own = chains.expect(chains.x @ theta, pair)
            return np.concatenate([chains.x.T @ (chains.line_w * (good - now)) - decay * theta, (moves - own).ravel() - decay * pair.ravel()])

        return grad

    # first each line by itself, from its own features, so that a line unlike its document stands out
    y, own = np.repeat(quality, sizes).astype(float), np.arange(chains.x.shape[1] + 4) < N_LINE
    alone = lambda both: np.where(own, np.append(chains.x.T @ (chains.line_w * (y - 1 / (1 + np.exp(-chains.x @ both[:-4])))), np.zeros(4)) - decay * both, 0.0)
    both = _adam(alone, np.zeros(len(own)), steps, rate)
    for _ in range(turns):
        pair = both[-4:].reshape(2, 2)
        good, moves = chains.expect(chains.held_to(quality, chains.x @ both[:-4], pair), pair)
        both = _adam(towards(good, moves), both, steps // 4, rate / 2)
    theta, pair = both[:-4], both[-4:].reshape(2, 2)
    field = LineField(theta, pair, 1.0, 0.0)
    s = np.clip(field.share(texts), 1e-6, 1 - 1e-6)
    z = np.log(s / (1 - s))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps for the curve, lightly held
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((quality - p) * z).sum() - 0.1 * (a - 1), (quality - p).sum() - 0.1 * b])
        v = p * (1 - p) + 1e-6
        hess = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        d = np.linalg.solve(hess, g)
        a, b = a + d[0], b + d[1]
        if np.abs(d).max() < 1e-8:
            break
    return LineField(theta, pair, float(max(a, 1e-3)), float(b))


def learn(docs: DataFrame, labels: DataFrame, max_documents: int = SAMPLE_DOCUMENTS, max_bytes: int = SAMPLE_BYTES) -> LineField:
    """Fit on at most ``max_documents`` labelled documents that aren't held out, of ``max_bytes`` together, drawn by hash."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 != 0))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.xxhash64("text").alias("h"), "text", "quality")
    # of repeated ids and long texts as many as the two bounds allow, chosen by their sizes alone; a text over the bound takes no place
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    turn = [F.greatest("size", F.lit(LONG_BYTES)), F.xxhash64("doc_id", "h"), "doc_id", "h"]
    sizes = texts.select("doc_id", "h", size.alias("size")).where(F.col("size") <= max_bytes).distinct().orderBy(*turn).limit(max_documents)
    upto = F.sum("size").over(Window.orderBy(*turn))
    kept = sizes.withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("doc_id", "h")
    got = texts.join(F.broadcast(kept), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).toArrow()
    order = sorted(range(got.num_rows), key=lambda k: (got["doc_id"][k].as_py(), got["h"][k].as_py()))
    t, q = got["text"].to_pylist(), got["quality"].to_numpy()
    return fit([t[k] for k in order], np.array([q[k] for k in order], float))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, field: LineField | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    field = field or learn(docs, labels)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, s = batch.column(0), _in_turn(field, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([held_out(x) for x in ids.to_pylist()], pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _in_turn(field: LineField, texts: pa.Array, at_once: int = 1 << 20) -> np.ndarray:
    """Scores, a MB of text at a time."""
    out, held, size = [np.zeros(0)], [], 0
    for x in texts:
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size > at_once:
            out.append(field.score(held))
            held, size = [], 0
    out.append(field.score(held))
    return np.concatenate(out)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, field: LineField | None = None) -> DataFrame:
    """The rows, with all their columns, that score at least ``threshold``."""
    field = field or learn(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in_turn(field, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
