"""Every domain query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import pytest

from tallyframe import catalog, registry

from .conftest import SMALL

assert catalog


def _norm(v):
    return round(v, 9) if isinstance(v, float) else v


def _key(row):
    return tuple("~" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = [tuple(map(_norm, r)) for r in df.select(*columns).collect()]
    cur = duck.execute(registry.ORACLES[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == columns
    expected = [tuple(_norm(r[at.index(c)]) for c in columns) for r in cur.fetchall()]
    assert sorted(rows, key=_key) == sorted(expected, key=_key)
    assert rows


ZONED = ["report_daily", "fn_fx_date", "filter_local_range", "ingest_stamp_records", "plan_value_by_month", "remainder_as_records", "series_range_bounds", "sink_record_export", "stream_minute_costs"]


@pytest.mark.parametrize("name", ZONED)
def test_the_session_zone_changes_nothing(spark, duck, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_query_equals_sql(spark, duck, name)
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rows_only_queries_run(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, SMALL).count() > 0, name


def test_stream_gate_equals_batch(spark):
    a = registry.QUERIES["stream_change_gate"](spark, SMALL).collect()
    b = registry.QUERIES["batch_change_gate"](spark, SMALL).collect()
    assert sorted(a) == sorted(b)


def test_breakdowns_add_up_to_the_headline(spark):
    rows = registry.QUERIES["breakdown_dimensions"](spark, SMALL).groupBy("dimension").agg({"n_calls": "sum", "share": "sum"}).collect()
    assert len({r["sum(n_calls)"] for r in rows}) == 1
    assert all(abs(r["sum(share)"] - 1) < 1e-4 for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
