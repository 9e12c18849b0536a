"""Where queries register: a Spark callable by name, and its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .fixtures import PRELUDE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@contextmanager
def in_utc(spark: SparkSession) -> Iterator[None]:
    """Days and hours are UTC whatever the session's zone: an expression takes the zone set while it is built, and keeps it."""
    name = "spark.sql.session.timeZone"
    before = spark.conf.get(name)
    spark.conf.set(name, "UTC")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def query(sql: str | None = None, name: str | None = None):
    """Register ``f(tables)`` under its name; ``sql`` is what follows the shared common tables."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered already")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            with in_utc(spark):
                return f(Tables(spark, sf_dir))

        QUERIES[key] = build
        if sql is not None:
            text = sql.strip()
            head, own = PRELUDE.rstrip(), text.upper()
            if own.startswith("WITH RECURSIVE "):
                ORACLES[key] = "WITH RECURSIVE " + head.removeprefix("WITH ") + ",\n" + text[15:]
            else:
                ORACLES[key] = head + (",\n" + text[5:] if own.startswith("WITH ") else "\n" + text)
        return f

    return add
