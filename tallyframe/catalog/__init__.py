"""Registers every query by importing the modules that define them."""

from . import attribution, calls, forecasts, ingest, maintenance, quota, report_queries, scalars, series, streams  # noqa: F401
