"""Rules by small cases that a careless reading gets wrong."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe import registry
from tallyframe.operators import attribution, maintenance, quota, reports

from .conftest import SMALL


def test_a_window_that_never_rose_has_no_price(spark):
    inst = [
        # account, win, model, reset, first, peak time, latest, rise, open, family
        ("a", "week", None, 1, 0, 100, 40.0, 40.0, True, None), ("a", "week", None, 2, 0, 100, 40.0, 0.0, True, None), ("b", "week", None, 3, 0, 100, 130.0, 10.0, True, None),
        ("a", "sonnet", None, 4, 500, 600, 60.0, 20.0, True, "sonnet"), ("a", "week", None, 5, 0, 100, 40.0, 40.0, False, None),
    ]
    i = spark.createDataFrame(inst, "account_uuid string, win string, model string, reset_min long, first_us long, peak_us long, latest double, rise double, open boolean, family string")
    calls = spark.createDataFrame([("a", 50, "opus", Decimal("8"), 30, 40), ("b", 50, "opus", Decimal("5"), 0, 0)], "account_uuid string, ts_us long, family string, cost decimal(30,10), cache_read long, observed long")
    got = {r["reset_min"]: r for r in quota.priced_instances(i, calls).collect()}
    assert (got[1]["spend"], got[1]["per_pp"], got[1]["headroom"], got[1]["n_calls"]) == (8, 0.2, 12.0, 1)
    assert [got[2][c] for c in ("spend", "per_pp", "headroom", "cache_read", "observed", "n_calls")] == [None] * 6
    assert got[3]["headroom"] == 0.0 and got[3]["per_pp"] == 0.5  # past 100 percent nothing is left
    assert (got[4]["spend"], got[4]["per_pp"], got[4]["n_calls"]) == (0, 0.0, 0)  # it rose without a call
    assert got[5]["headroom"] is None and got[5]["spend"] == 8
    g = quota.group_summary(quota.priced_instances(i, calls).withColumns({"peak": F.lit(1.0), "hit": F.lit(False), "added": F.lit(7).cast("long")})).where("win = 'week'").first()
    assert (g["spend"], g["usd_per_pp"], g["cache_hit"], g["extra_cents"]) == (21, round(21 / 90, 6), 0.75, 28)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_no_headroom_is_negative_and_none_without_a_rise(spark, sf):
    rows = registry.QUERIES["sink_limits_export"](spark, SMALL.replace("sf0.001", sf)).collect()
    assert rows and all((r["spend"] is None) == (r["usd_per_pp"] is None) for r in rows) and all(r["headroom"] >= 0 for r in rows if r["headroom"] is not None)


def test_families_add_up_to_the_week_window(spark):
    sf = SMALL.replace("sf0.001", "sf0.01")
    week = registry.QUERIES["windows_rolling_costs"](spark, sf).where("win = 'week'").first()["cost"]
    parts = registry.QUERIES["windows_week_by_family"](spark, sf).collect()
    assert sum(r["cost"] for r in parts) == pytest.approx(week, abs=1e-4) and week > 0
    session = registry.QUERIES["windows_rolling_costs"](spark, sf).where("win = 'session'").first()["cost"]
    assert session > 0


def test_family_costs_take_the_logged_cost_unless_it_is_0(spark):
    df = spark.createDataFrame([("opus-x", 5, Decimal(0), Decimal(3)), ("opus-y", 6, Decimal(2), Decimal(9)), ("zz", 5, None, Decimal(1)), ("opus-x", 1, None, Decimal(7)), ("opus-x", 9, None, Decimal(7))], "model string, ts_us long, log_cost decimal(30,10), computed decimal(30,10)")
    assert {r["family"]: r["cost"] for r in reports.family_costs(df, 5, 8).collect()} == {"opus": 5, "other": 1}


def test_one_silent_machine_makes_the_total_stale(spark):
    hour, now = 3_600_000_000, 100 * 3_600_000_000
    rest = spark.createDataFrame([("m1", now - 5, Decimal(3)), ("m1", now - 30 * hour, Decimal(4)), ("m2", now - 90 * hour, Decimal(5))], "machine_id string, ts_us long, cost decimal(30,10)")
    own = maintenance.own_windows(spark.createDataFrame([(now - 2 * hour, Decimal(1))], "ts_us long, cost decimal(30,10)"), now, (6, 48))
    remote = maintenance.remainder_windows(rest, now, (6, 48))
    assert {(r["machine_id"], r["win"]): r["cost"] for r in remote.collect()} == {("m1", "6h"): 3, ("m1", "48h"): 7, ("m1", "all"): 7, ("m2", "6h"): 0, ("m2", "48h"): 0, ("m2", "all"): 5}
    for silent, stale in ((now - 2 * hour, True), (now - hour, False)):
        pushed = spark.createDataFrame([("m1", now - 5), ("m2", silent), ("m9", 0)], "machine_id string, pushed_us long")
        got = {r["win"]: (r["cost"], r["machines"], r["oldest_us"], r["stale"]) for r in maintenance.merged_windows(own, remote, pushed, now).collect()}
        assert got == {"6h": (4, 2, silent, stale), "48h": (8, 2, silent, stale), "all": (13, 2, silent, stale)}
    alone = maintenance.merged_windows(own, remote.where("false"), pushed, now).where("win = 'all'").first()
    assert (alone["cost"], alone["machines"], alone["oldest_us"], alone["stale"]) == (1, 0, None, False)


def test_longest_prefix_equals_brute_force(spark):
    g = np.random.default_rng(4)
    names = ["a", "ab", "b", "c.d", "é", ""]
    path = lambda n: "/" + "/".join(str(g.choice(names)) for _ in range(n))
    prefixes = sorted({path(int(g.integers(1, 5))) for _ in range(60)})
    folders = [path(int(g.integers(1, 8))) for _ in range(400)] + [None, "", "/", "relative/a"]
    held = lambda f, p: f is not None and (f == p or f.startswith(p.rstrip("/") + "/"))
    df = spark.createDataFrame(list(enumerate(folders)), "id int, folder string")
    got = {r["id"]: r["prefix"] for r in attribution.longest_prefix(df, "folder", spark.createDataFrame([(p,) for p in prefixes if not p.endswith("/")], "prefix string"), "prefix").collect()}
    for k, f in enumerate(folders):
        assert got[k] == max((p for p in prefixes if not p.endswith("/") and held(f, p)), key=len, default=None), f


def test_few_and_many_rules_say_the_same(spark):
    g = np.random.default_rng(6)
    pick = lambda *xs: xs[int(g.integers(len(xs)))]
    ids = [(k, pick("a", "b", "c", None), pick(None, "git@h.example:t/a.git", "https://h.example/t/b", "x"), pick(None, "/w", "/w/a", "/w/ab/c", "/v/a", "w/a", "/")) for k in range(300)]
    records = spark.createDataFrame(ids, "n int, project string, repo string, cwd string")
    for seed in range(3):
        rows = [(k, kind, pick({"name": ["a", "b", "zz"], "remote": ["h.example/t/a", "h.example/t/b"], "cwd_prefix": ["/w", "/w/a", "/v", "w"]}[kind][k % 2], None), f"t{k}") for k, kind in enumerate(pick("name", "remote", "cwd_prefix") for _ in range(6))]
        rules = spark.createDataFrame(rows, "id int, match_kind string, match_value string, target string")
        one, other = (attribution.apply_rules(records, rules, few).select("n", "target") for few in (64, 0))
        assert one.exceptAll(other).count() == 0 == other.exceptAll(one).count() and one.where("target LIKE 't%'").count() > 20
    assert attribution.apply_rules(records, rules.where("false")).where("target <=> project").count() == 300
