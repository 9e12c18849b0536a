"""Quality rules: a decision list learned by sequential covering.

``text_statistics`` turns each text into a handful of numbers with built-in functions;
``learn_rules`` grows and prunes conjunctions of thresholds against labelled documents with
Spark aggregations; ``verdict`` writes the list as one ordered conditional expression.

Null and empty texts: all statistics 0. Repeated rows count as often as they occur. An empty
label table gives an empty list, which keeps every document. ``text_statistics`` carries other
columns along untouched; ``apply_rules`` returns the id, the statistics and the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, materialize, space_words

WINDOW = 5


def _repeated(words: Column) -> Column:
    """Words inside windows that occur twice or more: the union of [start, start + WINDOW)."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.coalesce(F.least(F.lit(WINDOW), F.get(starts, k + 1) - s), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def twins(pairs: Column) -> Column:
        own = F.transform(
            pairs,
            lambda p, k: F.when((p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]), p["i"]),
        )
        return F.sort_array(F.filter(own, lambda i: i.isNotNull()))

    def count(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(bind(bind(pairs, twins), covered))

    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return bind(F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])), count)


def text_statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Counts and rates of each whole text; windows are told apart by a 64-bit hash within a text.

    Words and lines are bound once per row as lambda variables: were they columns of their own,
    a filter pushed down by the optimizer could split the text again for each of its words.
    """
    p = prefix
    t = F.coalesce(F.col(text), F.lit(""))
    by_word = bind(space_words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        _repeated(w).cast("long").alias("n_repeat_words"),
    ))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    by_line = bind(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda y: y.rlike("[.!?\"')\\]][\\x20\\x09-\\x0D]*$"))).cast("long").alias("n_ended"),
    ))
    only = lambda others: F.char_length(F.regexp_replace(t, others, "")).cast("long")
    counted = docs.withColumns({
        f"{p}__w": by_word, f"{p}__l": by_line,
        f"{p}word_chars": only("[\\x20\\x09-\\x0D]+"), f"{p}n_symbols": only("[^#*$%&|<>]+"),
        f"{p}n_upper": only("[^A-Z]+"), f"{p}n_marks": only("[^!?]+"), f"{p}n_digits": only("[^0-9]+"),
    })
    out = counted.withColumns(
        {f"{p}{k}": F.col(f"{p}__w")[k] for k in ("n_words", "n_distinct", "n_repeat_words")}
        | {f"{p}{k}": F.col(f"{p}__l")[k] for k in ("n_lines", "n_dup_lines", "n_ended")}
    ).drop(f"{p}__w", f"{p}__l")
    c = lambda name: F.col(f"{p}{name}")
    rate = lambda a, b: F.coalesce(F.try_divide(c(a).cast("double"), c(b).cast("double")), F.lit(0.0))
    return out.withColumns({
        f"{p}r_word_length": rate("word_chars", "n_words"),
        f"{p}r_symbols": rate("n_symbols", "n_words"),
        f"{p}r_upper": rate("n_upper", "word_chars"),
        f"{p}r_marks": rate("n_marks", "n_words"),
        f"{p}r_digits": rate("n_digits", "word_chars"),
        f"{p}r_distinct": rate("n_distinct", "n_words"),
        f"{p}r_dup_lines": rate("n_dup_lines", "n_lines"),
        f"{p}r_repeat_words": rate("n_repeat_words", "n_words"),
        f"{p}r_ended": rate("n_ended", "n_lines"),
        f"{p}r_line_words": rate("n_words", "n_lines"),
    })


RATES = ["r_word_length", "r_symbols", "r_upper", "r_marks", "r_digits", "r_distinct", "r_dup_lines", "r_repeat_words", "r_ended", "r_line_words"]


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def test(self, prefix: str = "") -> Column:
        c = F.col(f"{prefix}{self.feature}")
        return c > self.threshold if self.above else c <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Reject where every literal holds."""

    literals: tuple[Literal, ...]
    rejected: int = field(default=0, compare=False)
    lost: int = field(default=0, compare=False)

    def test(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for x in self.literals:
            out = out & x.test(prefix)
        return out


def learn_rules(
    labelled: DataFrame,
    features: list[str] = RATES,
    bad: str = "bad",
    max_rules: int = 8,
    max_literals: int = 3,
    n_thresholds: int = 24,
    min_precision: float = 0.9,
    min_cover: int = 3,
) -> list[Rule]:
    """Sequential covering over ``labelled`` (features and a boolean ``bad``).

    Two thirds of the rows grow a rule, literal by literal, by information gain over binned
    counts; the other third prunes it from the end by (p - n) / (p + n). A rule stays if its
    precision holds on both parts. Rows that it covers leave, and the next rule is grown.
    Only counts by feature and bin (bounded by features x thresholds) reach the driver.
    """
    import math

    probs = [(i + 0.5) / n_thresholds for i in range(n_thresholds)]
    cuts_of = lambda rows: rows.agg(*[F.percentile_approx(f, probs, 2000).alias(f) for f in features])
    both = cuts_of(labelled.where(F.col(bad))).unionByName(cuts_of(labelled.where(~F.col(bad)))).collect()
    cuts = {f: sorted({float(x) for r in both for x in (r[f] or [])}) for f in features}
    marked = labelled.withColumn("__grow", F.pmod(F.xxhash64(*features), F.lit(3)) < 2)
    def bin_of(f: str) -> Column:
        """How many of the feature's thresholds lie below its value."""
        value = F.col(f)
        return F.size(F.filter(F.array(*[F.lit(x) for x in cuts[f]]).cast("array<double>"), lambda t: t < value))

    bins = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in features])).alias("fb")
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        literals: list[Literal] = []
        inside = left
        while len(literals) < max_literals:
            got = marked.where(F.col("__grow") & inside).select(bins, F.col(bad).alias("y")).groupBy("fb.f", "fb.b").agg(
                F.sum(F.col("y").cast("long")).alias("p"), F.sum((~F.col("y")).cast("long")).alias("n")
            ).collect()
            by: dict[str, dict[int, tuple[int, int]]] = {}
            for r in got:
                by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
            p0, n0 = (sum(v[i] for v in by.get(features[0], {}).values()) for i in (0, 1))
            if p0 < min_cover or n0 == 0:
                break
            best, gain0 = None, 1e-9
            prior = math.log2((p0 + 1) / (p0 + n0 + 2))
            for f in features:
                p = n = 0
                for b in range(len(cuts[f])):
                    dp, dn = by.get(f, {}).get(b, (0, 0))
                    p, n = p + dp, n + dn
                    for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if pp >= min_cover and (gain := pp * (math.log2((pp + 1) / (pp + nn + 2)) - prior)) > gain0:
                            best, gain0 = Literal(f, above, cuts[f][b]), gain
            if best is None:
                break
            literals.append(best)
            inside = inside & best.test()
        if not literals:
            break
        held = [Rule(tuple(literals[: k + 1])).test() for k in range(len(literals))]
        y, g = F.col(bad), F.col("__grow")
        one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
        row = marked.where(left).agg(*[
            one(h & part & cls).alias(f"c{k}_{a}_{b}") for k, h in enumerate(held) for a, part in enumerate((g, ~g)) for b, cls in enumerate((y, ~y))
        ]).first()
        worth = lambda k: (row[f"c{k}_1_0"] - row[f"c{k}_1_1"]) / max(1, row[f"c{k}_1_0"] + row[f"c{k}_1_1"])
        k = max(range(len(literals)), key=lambda i: (worth(i), -i))
        p, n = (row[f"c{k}_0_{b}"] + row[f"c{k}_1_{b}"] for b in (0, 1))
        sound = all(row[f"c{k}_{a}_0"] >= min_precision * (row[f"c{k}_{a}_0"] + row[f"c{k}_{a}_1"]) for a in (0, 1))
        if p < min_cover or not sound:
            break
        rules.append(Rule(tuple(literals[: k + 1]), p, n))
        left = left & ~rules[-1].test()
    return rules


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The number of the first rule that rejects (from 1), else 0: one ordered conditional expression."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].test(prefix), F.lit(k)).otherwise(out)
    return out


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """Statistics of a bounded sample of the labelled documents, and whether the label calls them bad.

    ``max_labelled`` bounds the sample: the labelled ids that come first by hash. More labels
    than that change nothing in the cost. A document with several labels counts as bad if one
    of them says so. Documents that fail the base rule are not judged by the list and stay out.
    """
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return text_statistics(own).select(*RATES, "bad", base_failed().alias("base_failed"))


def apply_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """(doc_id, statistics, base_failed, rule, kept) of every document."""
    labelled = materialize(labelled_statistics(docs, labels, max_labelled), "labelled")
    rules = learn_rules(labelled.where(~F.col("base_failed")).drop("base_failed"))
    out = text_statistics(docs.select("doc_id", "text")).drop("text")
    out = out.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
