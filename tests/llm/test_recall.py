"""The learned list and licence spans against plain evaluation of what they claim."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tallyframe.llm import licences, quality_rules

from ..conftest import SMALL

SPACE = " \t\n\x0b\x0c\r"


def plain_rates(text):
    """The statistics that rules test, by their names."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows: dict[tuple, int] = {}
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])] = windows.get(tuple(words[k : k + 5]), 0) + 1
    repeated = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    n, chars, rows = len(words), sum(map(len, words)), len(lines)
    count = lambda pattern: len(re.findall(pattern, text))
    rate = lambda a, b: a / b if b else 0.0
    return n, len(repeated), {
        "r_word_length": rate(chars, n), "r_symbols": rate(count(r"[#*$%&|<>]"), n), "r_upper": rate(count("[A-Z]"), chars), "r_marks": rate(count("[!?]"), n), "r_digits": rate(count("[0-9]"), chars),
        "r_distinct": rate(len(set(words)), n), "r_dup_lines": rate(rows - len(set(lines)), rows), "r_repeat_words": rate(len(repeated), n),
        "r_ended": rate(sum(bool(re.search(r"[.!?\"')\]][\x20\x09-\x0D]*$", x)) for x in lines), rows), "r_line_words": rate(n, rows),
    }


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_kept_is_what_the_rules_say(spark, sf):
    at = SMALL.replace("sf0.001", sf)
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    rows = quality_rules.labelled_statistics(docs, labels)
    rules = quality_rules.learn_rules(rows.where("NOT base_failed").drop("base_failed"))
    assert rules
    got = {r["doc_id"]: (r["rule"], r["kept"]) for r in quality_rules.apply_rules(docs, labels).collect()}
    for r in docs.select("doc_id", "text").collect():
        n, repeated, rates = plain_rates(r["text"])
        first = next((k for k, rule in enumerate(rules, 1) if all((rates[x.feature] > x.threshold) == x.above for x in rule.literals)), 0)
        assert got[r["doc_id"]] == (first, n >= 10 and 100 * repeated <= 20 * n and first == 0), r["doc_id"]
    # what the list rejects is bad by the labels, nearly always
    bad = {r["doc_id"] for r in labels.where("quality = 0").select("doc_id").collect()}
    known = {r["doc_id"] for r in labels.where("quality IS NOT NULL").select("doc_id").collect()}
    rejected = {i for i, (rule, _) in got.items() if rule} & known
    assert len(rejected & bad) >= 0.9 * len(rejected)


def words_of(text):
    return [w for w in re.split("[^0-9a-z]+", text.lower()) if w]


def test_edited_notices_inside_longer_lines_are_found(spark):
    """Every notice that a window of its template's length matches at 0.8, up to 9 % of its words changed, wherever it stands."""
    g = np.random.default_rng(11)
    known = [(k, name, words_of(text)) for k, (name, text) in enumerate(licences.TEMPLATES) if len(words_of(text)) >= 12]
    docs, planted = [], []
    for k in range(240):
        template, name, ws = known[k % len(known)]
        edited = list(ws)
        for at in g.choice(len(ws), int(len(ws) * g.uniform(0, 0.09)), replace=False):
            edited[at] = f"x{g.integers(100)}"
        before, after = ([f"w{v}" for v in g.integers(0, 500, g.integers(0, 60))] for _ in range(2))
        docs.append((k, " ".join(before + edited + after)))
        planted.append((k, name, len(before), set(zip(ws, ws[1:])), len(ws)))
    found = {(r["doc_id"], r["licence"]) for r in licences.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    matching = []
    for k, name, _, grams, n in planted:
        ws = words_of(docs[k][1])
        best = max(2 * len((own := set(zip(ws[s : s + n], ws[s + 1 : s + n]))) & grams) / (len(own) + len(grams)) for s in range(max(1, len(ws) - n + 1)))
        if best >= licences.THRESHOLD:
            matching.append((k, name))
    assert len(matching) > 150
    assert sum(m in found for m in matching) >= 0.99 * len(matching)
