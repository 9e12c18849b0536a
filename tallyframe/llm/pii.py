"""Personal data: candidates from high-recall generators, chosen by gradient-boosted trees.

The base rules (fixed patterns with their checks) always stand. Beside them, generators
propose overlapping spans that the greedy patterns miss: numbers inside longer runs of
digits, groups of four, other signs between groups, addresses with spelled-out signs. Boosted trees
over format and context features decide on them alone. They are fitted on what they will be asked:

* positive: what the base rules found, as it stands and once more in each of the forms that only
  the generators know (``_forms``), in its own place or behind a word that announces it;
* negative: found spans made wrong in the same forms (``_decoys``), and the candidates of the same
  documents that no base rule explains. Personal data among the latter would teach the opposite, so
  those that a first fit takes for positive are left out of the second.

On the third of the candidates that is held back, isotonic regression makes probabilities of the
scores, kind by kind, and a candidate is chosen whose probability is ``min_precision`` or more. Trees
are fitted on at most ``max_examples`` candidates of a sample of documents, drawn by hash.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Repeated rows are
handled one by one. A corpus without candidates gives a model that adds nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
#: Documents (about) whose candidates the trees are fitted on.
SAMPLE_DOCUMENTS = 8_000
#: Candidates that they are fitted on at most, so that the driver's part is bounded whatever the documents hold.
SAMPLE_EXAMPLES = 60_000
#: Values of a feature that cuts tell apart.
BINS = 33

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# one start a run of digits is enough: every start in it goes on alike
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_SPELLED = re.compile(r"[(\[{<]\s?at\s?[)\]}>]", re.I)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @, so that long words cost no more than once."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        low = m.end() if m else at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base rules' spans, by kind as listed, then start."""
    if not _ANY.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for kind, pattern, low, high in (("card", _CARD, 13, 19), ("phone", _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            d = _digits(m.group())
            if low <= len(d) <= high and (kind == "phone" or luhn(d)):
                out.append((kind, *m.span()))
    return out


_BETWEEN = r"[\x20.\-/\u2010-\u2014\u00b7]"
_DOT = r"\s?(?:\.|[(\[{<]\s?(?:dot|\.)\s?[)\]}>])\s?"
_GENERATORS = (
    ("card", re.compile(r"[0-9]{12,20}")),
    ("card", re.compile(rf"[0-9]{{4}}(?:{_BETWEEN}[0-9]{{4}}){{2,3}}(?:{_BETWEEN}[0-9]{{1,4}})?")),
    ("phone", re.compile(rf"\+?[(\[]?[0-9]{{1,4}}[)\]]?(?:{_BETWEEN}{{1,2}}[(\[]?[0-9]{{2,5}}[)\]]?){{1,4}}")),
    ("phone", re.compile(r"\+?[0-9]{9,15}")),
    ("ip", re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}", re.I)),
    ("email", re.compile(rf"[\w.%+-]{{1,64}}\s?(?:@|{_SPELLED.pattern})\s?[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}}){{1,5}}", re.I)),
)
_NEAR = re.compile(r"(tel|phone|call|fax|mobile)|(card|visa|credit|pay)|(mail|contact|write)|(\bip\b|host|server|addr)", re.I)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans that might be personal data."""
    signs = "@" in text or _SPELLED.search(text) is not None
    if not signs and not _ANY.search(text):
        return []
    found = dict.fromkeys((kind, *m.span()) for kind, g in _GENERATORS if signs or kind != "email" for m in g.finditer(text))
    found |= dict.fromkeys(base_spans(text))
    return list(found)


N_FEATURES = 29


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    s, left, right = text[a:b], text[max(0, a - 24) : a], text[b : b + 12]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    octets = [int(x) for x in groups] if len(groups) == 4 and max(map(len, groups)) < 6 else []
    words = [0.0] * 4
    for m in _NEAR.finditer(left):
        words[m.lastindex - 1] = 1.0
    sizes = list(map(len, groups)) or [0]
    return [
        *(float(kind == k) for k in KINDS), len(s), len(d), len(d) / max(1, len(s)), float(luhn(d)) if d else 0.0,
        len(set(d)), s.count(" ") + s.count("-"), s.count("."), float(s[:1] == "+"), float("(" in s), s.count("@"),
        float(len(octets) == 4 and max(octets) <= 255), float(left[-1:].isalnum()), float(right[:1].isalnum()),
        float(bool(re.match(r"[\x20.\-]?[0-9]", right))) + float(bool(re.search(r"[0-9][\x20.\-]?$", left))), *words,
        len(groups), min(sizes), max(sizes), float(bool(_DATE.match(s))), float(bool(_SPELLED.search(s))), float(bool(re.search(r"[A-Za-z]{2,63}$", s))), float(bool(re.match(r"[0-9]{1,2}:[0-9]", right))),
    ]


_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}")


def _forms(kind: str, s: str) -> list[str]:
    """A span in forms that only the generators know."""
    d = _digits(s)
    if kind == "email" and "@" in s:
        local, domain = s.split("@")
        return [f"{local} (at) {domain.replace('.', ' (dot) ')}", f"{local}[at]{domain.replace('.', '[dot]')}", f"{local} @ {domain}"]
    if kind == "card":
        fours = [d[k : k + 4] for k in range(0, len(d), 4)]
        return [".".join(fours), "/".join(fours)] if len(d) % 4 != 1 or len(d) == 13 else []
    if kind == "ip":
        return [s.replace(".", "[.]"), s.replace(".", " . ")]
    if kind == "phone" and len(d) >= 10:
        d = d[-10:]
        return [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:3]} / {d[3:6]} {d[6:]}"]
    return []


def _decoys(kind: str, s: str) -> list[str]:
    """A found span made wrong: what looks alike in the same place, but isn't personal data."""
    d = _digits(s)
    if kind == "card":
        wrong = s[:-1] + str((int(s[-1]) + 1 + len(s) % 8) % 10)
        return [wrong, *_forms(kind, wrong)]
    if kind == "ip":
        wrong = "399" + s[s.index(".") :]
        return [wrong, *_forms(kind, wrong)]
    if kind == "phone":
        # counts, amounts, dates, serial and book numbers: too few digits or no groups that a number has
        day = f"20{d[-2:]}-{1 + int(d[-3]) % 9:02d}-{1 + int(d[-4]) % 28:02d}"
        return [f"{d[-8:-4]}.{d[-4:]}", f"{d[-6:-4]} {d[-4:-2]} {d[-2:]}", d[-8:], d[-10:], day, f"{day} {d[-2:]}", f"{d[-4:]}-{d[-4:-2]}", f"978-{d[0]}-{d[1:5]}-{d[-4:]}-{d[-1]}"]
    return [s.replace(".", ""), s.replace("@", " at "), re.sub(r"\.[A-Za-z-]+$", ".7", s)]


#: Words that announce a kind, put before a form now and then so that context counts beside the format.
_CUES = {"email": "mail: ", "ip": "host ", "card": "card no. ", "phone": "Tel. "}


def _examples(text: str) -> list[tuple[int, str, int, list[float]]]:
    """(rank, kind, label, features); label 2 stands for a candidate that no base rule explains. The rank is a hash of what features see."""
    out, base = [], base_spans(text)

    def add(text: str, kind: str, a: int, b: int, y: int) -> None:
        out.append((zlib.crc32(text[max(0, a - 24) : b + 12].encode(errors="replace")), kind, y, features(text, kind, a, b)))

    kept = set(base)
    for kind, a, b in candidates(text):
        if (kind, a, b) in kept:
            add(text, kind, a, b, 1)
        elif not any(x < b and a < y for _, x, y in base):
            add(text, kind, a, b, 2)
        elif not any(x <= a and b <= y and k == kind for k, x, y in base):
            add(text, kind, a, b, 0)  # a base span read as another kind, or with what isn't part of it
    for kind, a, b in base:
        # what stands next to a span is as far as features look
        before, after = text[max(0, a - 24) : a], text[b : b + 12]
        for y, forms in ((1, _forms(kind, text[a:b])), (0, _decoys(kind, text[a:b]))):
            for form in forms:
                for left in (before, before[-24 + len(_CUES[kind]) :] + _CUES[kind]):
                    if y or left is before or kind != "phone":
                        add(left + form + after, kind, len(left), len(left) + len(form), y)
        # a bare number is a phone number behind a word that says so
        if kind == "phone" and 10 <= len(d := _digits(text[a:b])):
            left = before[-24 + len(_CUES[kind]) :] + _CUES[kind]
            add(left + d[-10:] + after, kind, len(left), len(left) + 10, 1)
    return out


@dataclass
class Boosted:
    """Depth-limited trees for log odds: arrays of (feature, threshold, leaves).

    ``calibration`` has for each kind the odds from which on a probability holds, rising.
    """

    base: float
    trees: list
    thresholds: dict[str, float]
    calibration: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def probability(self, kind: str, odds: np.ndarray) -> np.ndarray:
        """Calibrated; 0 below all held-back candidates of the kind and where there are none."""
        start, p = self.calibration.get(kind, (np.empty(0), np.empty(0)))
        return np.concatenate(([0.0], p))[np.searchsorted(start, odds, "right")]

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(len(feature)):
                node = 2 * node + (x[np.arange(len(x)), feature[level][node]] > cut[level][node])
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step function nearest to y (least squares): where each step starts and its value."""
    start, n = np.unique(score, return_counts=True)
    total = np.bincount(np.searchsorted(start, score), y, len(start))
    steps: list[list[float]] = []  # start, sum, size: neighbours out of order are pooled
    for step in zip(start.tolist(), total.tolist(), n.tolist()):
        steps.append(list(step))
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, add, size = steps.pop()
            steps[-1][1] += add
            steps[-1][2] += size
    return np.array([s[0] for s in steps]), np.array([s[1] / s[2] for s in steps])


def fit(x: np.ndarray, y: np.ndarray, kinds: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, min_precision: float = 0.99, min_support: int = 5) -> Boosted:
    """Newton boosting on logistic loss; a third of the rows is held back to set the thresholds."""
    never = dict.fromkeys(KINDS, np.inf)
    if len(y) == 0 or y.min() == y.max():
        return Boosted(0.0, [], never)
    hold = np.arange(len(y)) % 3 == 0
    xt, yt = x[~hold], y[~hold]
    # values once as bins: a node's best cut is then a matter of two counts
    cuts = [np.unique(np.quantile(xt[:, j], np.linspace(0, 1, BINS)))[:-1] for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, xt[:, j], "left") for j, c in enumerate(cuts)], 1)
    place = bins + np.arange(x.shape[1]) * BINS
    base = float(np.log((yt.sum() + 1) / (len(yt) - yt.sum() + 1)))
    score, trees = np.full(len(yt), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = yt - p, p * (1 - p) + 1e-6
        node, feature, cut = np.zeros(len(yt), np.int64), [], []
        for level in range(depth):
            size = x.shape[1] * BINS
            at = (node[:, None] * size + place).ravel()
            sums = [np.bincount(at, np.repeat(v, x.shape[1]), size << level).reshape(1 << level, x.shape[1], BINS) for v in (g, h, np.ones(len(yt)))]
            (gb, gt), (hb, ht), (nb, nt) = ((v.cumsum(axis=2), v.sum(axis=2, keepdims=True)) for v in sums)  # up to each cut, and all
            gain = gb**2 / (hb + 1) + (gt - gb) ** 2 / (ht - hb + 1) - gt**2 / (ht + 1)
            gain = np.where((nb > 0) & (nb < nt) & (nt >= 8), gain, 0.0).reshape(1 << level, -1)
            best = gain.argmax(axis=1)
            f_level, c_level = best // BINS, np.full(1 << level, np.inf)
            for n in np.flatnonzero(gain.max(axis=1) > 1e-6):
                c_level[n] = cuts[f_level[n]][best[n] % BINS]
            feature.append(f_level)
            cut.append(c_level)
            node = 2 * node + (xt[np.arange(len(yt)), f_level[node]] > c_level[node])
        leaf = np.array([rate * g[node == n].sum() / (h[node == n].sum() + 1) for n in range(1 << depth)])
        score += leaf[node]
        trees.append((feature, cut, leaf))
        if np.abs(g).max() < 0.02:
            break
    model = Boosted(base, trees, never)
    odds = model.odds(x[hold])
    for k in KINDS:
        own = kinds[hold] == k
        if not own.any():
            continue
        start, p = model.calibration[k] = isotonic(odds[own], y[hold][own])
        good = np.flatnonzero(p >= min_precision)
        if len(good) and (odds[own] >= start[good[0]]).sum() >= min_support:
            # half way between the first score of the good step and what was seen below it
            below = odds[own][odds[own] < start[good[0]]]
            model.thresholds[k] = float((start[good[0]] + below.max()) / 2) if len(below) else float(start[good[0]])
    return model


def learn(docs: DataFrame, max_documents: int = SAMPLE_DOCUMENTS, max_examples: int = SAMPLE_EXAMPLES) -> Boosted:
    """Fit on at most ``max_examples`` candidates of about ``max_documents`` documents, both drawn by hash."""
    share = min(1.0, max_documents / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 52)) < int(share * (1 << 52))
    sample = docs.where(drawn & F.col("text").rlike(r"[0-9@]|(?i)[(\[{<]\s?at\s?[)\]}>]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                own = _examples(x.as_py())
                if own:
                    ranks, kinds, y, rows = zip(*own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ranks, pa.int64()), pa.array(kinds), pa.array(y, pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
                        names=["rank", "kind", "y", "x"],
                    )

    examples = sample.select("text").mapInArrow(run, "rank long, kind string, y int, x array<double>")
    rows = examples.distinct().orderBy("rank", "kind", "y", "x").limit(max_examples).toArrow()  # copies count once
    kinds, y = np.array(rows.column("kind").to_pylist(), object), rows.column("y").to_numpy().astype(float)
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(y), N_FEATURES)
    mix = np.random.default_rng(7).permutation(len(y))
    x, y, kinds = x[mix], y[mix], kinds[mix]
    first = fit(x, np.where(y == 1, 1.0, 0.0), kinds)
    # what no rule explains but looks like personal data teaches nothing
    doubt = (y == 2) & (np.array([first.odds(x)]).ravel() > 0)
    return fit(x[~doubt], np.where(y[~doubt] == 1, 1.0, 0.0), kinds[~doubt])


def all_spans(text: str, model: Boosted) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, all): the base rules' spans and those with the chosen candidates, non-overlapping ones, added."""
    base = base_spans(text)
    others = [c for c in candidates(text) if not any(x < c[2] and c[1] < y for _, x, y in base)] if model.trees else []
    if not others:
        return base, base
    odds = model.odds(np.array([features(text, *c) for c in others], float))
    added: list[tuple[str, int, int]] = []
    for k in np.argsort(-odds, kind="stable"):
        kind, a, b = others[k]
        if odds[k] >= model.thresholds[kind] and not any(x < b and a < y for _, x, y in added):
            added.append(others[k])
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_spans(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """(doc_id, base, spans): arrays of kind:start:end."""
    model = model or learn(docs)
    kept = docs.sparkSession.sparkContext.broadcast(model)  # some tens of small trees
    strings = T.ArrayType(T.StringType())
    schema = T.StructType([docs.schema["doc_id"], T.StructField("base", strings), T.StructField("spans", strings)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [all_spans(x.as_py() or "", kept.value) for x in batch.column(1)]
            columns = [pa.array([[f"{k}:{a}:{b}" for k, a, b in x[j]] for x in both], pa.list_(pa.string())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch of overlapping spans gives way to the kind of the one that starts first."""
    out, at, end = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a] if end >= at else "", f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """The same rows and columns with personal data replaced; n_chars, where there is one, follows the text."""
    model = model or learn(docs)
    kept = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t if t is None or not (s := all_spans(t, kept.value)[1]) else redact_text(t, s) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if counted is not None:
                n = columns[counted].to_pylist()
                columns[counted] = pa.array([m if a == b else len(b) for m, a, b in zip(n, old, new)], columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
