"""A stored rollup follows its inputs: all of them, and no further than they moved."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyframe.catalog import maintenance as catalog
from tallyframe.fixtures import Tables
from tallyframe.operators.rollups import StampedRollup
from tallyframe.operators.stored import shared_path

from .conftest import SMALL


def calls(spark, rows):
    return spark.createDataFrame(rows, "day string, project string, cost long, is_dup boolean")


ROWS = [("2024-01-01", "a", 1, False), ("2024-01-01", "b", 2, False), ("2024-01-02", "a", 4, False), ("2024-01-02", "a", 4, True), ("2024-01-03", None, 8, False)]


def small(spark, rows):
    return spark.createDataFrame(rows, "k string, v int")


@pytest.fixture
def rollup(spark):
    return StampedRollup(spark, shared_path(spark, "stamped"))


def refresh(spark, rollup, rows, rules=(("x", 1),), prices=(("p", 1),)):
    fold = lambda df: df.where("NOT is_dup").groupBy("day", "project").agg(F.sum("cost").alias("cost"))
    return rollup.refresh(calls(spark, rows), {"rules": small(spark, list(rules)), "prices": small(spark, list(prices))}, fold)


def content(rollup):
    return sorted(((r["day"], r["project"], r["cost"]) for r in rollup.read().collect()), key=str)


def test_only_what_moved_is_made_anew(spark, rollup):
    days = ["2024-01-01", "2024-01-02", "2024-01-03"]
    first = [("2024-01-01", "a", 1), ("2024-01-01", "b", 2), ("2024-01-02", "a", 4), ("2024-01-03", None, 8)]
    assert refresh(spark, rollup, ROWS) == days and content(rollup) == first
    assert refresh(spark, rollup, ROWS[::-1]) == [] and content(rollup) == first
    # a late file: its day alone
    late = [*ROWS, ("2024-01-02", "c", 5, False)]
    assert refresh(spark, rollup, late) == ["2024-01-02"]
    assert content(rollup) == sorted([*first, ("2024-01-02", "c", 5)], key=str)
    # a verdict that changed on another day, and rows that repeat
    flipped = [(d, p, c, False) for d, p, c, _ in late] + [ROWS[0], ROWS[0]]
    assert refresh(spark, rollup, flipped) == ["2024-01-01", "2024-01-02"]
    assert ("2024-01-02", "a", 8) in content(rollup) and ("2024-01-01", "a", 3) in content(rollup)
    # a day that is gone, and a new one
    assert refresh(spark, rollup, [r for r in flipped if r[0] != "2024-01-03"] + [("2024-01-09", "z", 1, False)]) == ["2024-01-09"]
    assert {d for d, _, _ in content(rollup)} == {"2024-01-01", "2024-01-02", "2024-01-09"}


@pytest.mark.parametrize("moved", [{"rules": [("x", 2)]}, {"rules": [("x", 1), ("x", 1)]}, {"prices": [("p", 1), ("q", 1)]}, {"prices": []}])
def test_any_other_input_refreshes_all_days(spark, rollup, moved):
    refresh(spark, rollup, ROWS)
    assert len(refresh(spark, rollup, ROWS, **moved)) == 3
    assert refresh(spark, rollup, ROWS, **moved) == []


def test_a_refresh_that_broke_off_leaves_the_version_before(spark, rollup):
    refresh(spark, rollup, ROWS)
    before = content(rollup)
    refresh(spark, rollup, [(d, p, c + 1, x) for d, p, c, x in ROWS])
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{rollup.path}/stamps/version=1")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    assert content(rollup) == before
    assert len(refresh(spark, rollup, [(d, p, c + 2, x) for d, p, c, x in ROWS])) == 3
    assert ("2024-01-03", None, 10) in content(rollup)


def test_no_calls(spark, rollup):
    assert refresh(spark, rollup, []) == []


def test_late_files_rewrite_their_days_alone(spark):
    t = Tables(spark, SMALL)
    _, (first, second, third) = catalog.refreshed_rollup(t)
    late = t.rec.where(catalog._LATE)
    keys = late.where("dk <> ''").select("account_uuid", "dk").distinct()
    days = {r["day"] for r in late.select("day").union(t.rec.join(keys, ["account_uuid", "dk"], "left_semi").select("day")).distinct().collect()}
    assert third == [] and second and set(second) <= days and len(second) < len(first)
