"""Row-level functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import NOW
from ..functions import names
from ..registry import query
from .report_queries import FAMILY, SHORT

SALT = "salt"
REMOTE = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(repo), '^[A-Za-z+]+://', ''), '^[^@/]+@', ''), '^([^/:]+):(?:[0-9]+/)?', '\\1/'), '(\\.git)?/*$', '')"""


@query(f"SELECT DISTINCT model, {FAMILY} AS family FROM rec")
def fn_model_family(t):
    return t.rec.select("model", names.model_family(F.col("model")).alias("family")).distinct()


@query(f"SELECT DISTINCT model, {SHORT} AS short FROM rec")
def fn_short_model(t):
    return t.rec.select("model", names.short_model(F.col("model")).alias("short")).distinct()


@query("SELECT rid, day, substr(day, 1, 7) AS month, strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d') AS week FROM rec")
def fn_calendar_keys(t):
    week = F.date_format(F.date_trunc("week", F.to_date("day")), "yyyy-MM-dd")
    return t.rec.select("rid", "day", F.substring("day", 1, 7).alias("month"), week.alias("week"))


@query("SELECT rid, strftime(make_timestamp(ts_us + 3600000000), '%Y-%m-%d') AS fx_date FROM rec")
def fn_fx_date(t):
    """The record's own date where it carries one, else the date in Oslo; odd ids carry none here."""
    own = F.when(F.col("rid") % 2 == 0, F.col("oslo_date"))
    local = F.date_format(F.from_utc_timestamp(F.timestamp_micros("ts_us"), "Europe/Oslo"), "yyyy-MM-dd")
    return t.rec.select("rid", F.coalesce(own, local).alias("fx_date"))


@query("""SELECT rid, CASE WHEN dk IS NOT NULL AND dk <> '' THEN 'k|' || dk WHEN coalesce(mid, '') = '' AND input_tokens + output_tokens + cache_create + cache_read = 0 THEN NULL
 ELSE 'f|' || coalesce(mid,'') || '|' || coalesce(sid,'') || '|' || ts_us || '|' || model || '|' || input_tokens || '|' || output_tokens || '|' || cache_create || '|' || cache_read END AS ident FROM rec""")
def fn_dedup_identity(t):
    return t.rec.select("rid", names.dedup_identity().alias("ident"))


_REMOTES = "SELECT rid, CASE rid % 4 WHEN 0 THEN repo WHEN 1 THEN 'https://user:pw@host.example/team/' || project || '.git/' WHEN 2 THEN 'ssh://git@host.example:2222/team/' || project ELSE 'host.example:team/' || project END AS repo FROM rec WHERE project IS NOT NULL"


@query(f"SELECT rid, {REMOTE} AS remote FROM ({_REMOTES})")
def fn_normalize_remote(t):
    p = F.col("project")
    spelled = F.when(F.col("rid") % 4 == 0, F.col("repo")).when(F.col("rid") % 4 == 1, F.concat(F.lit("https://user:pw@host.example/team/"), p, F.lit(".git/"))).when(
        F.col("rid") % 4 == 2, F.concat(F.lit("ssh://git@host.example:2222/team/"), p)).otherwise(F.concat(F.lit("host.example:team/"), p))
    return t.rec.where("project IS NOT NULL").select("rid", names.normalize_remote(spelled).alias("remote"))


@query(f"SELECT rid, coalesce(nullif(regexp_extract({REMOTE}, '([^/]*)$', 1), ''), nullif(regexp_extract(cwd, '^/w/([^/]+)', 1), ''), nullif(regexp_extract(cwd, '([^/]*)$', 1), ''), 'unknown') AS name FROM rec")
def fn_project_name(t):
    return t.rec.select("rid", names.project_name(F.col("repo"), F.col("cwd"), ("/w",), F.lit("unknown")).alias("name"))


@query("SELECT rid, translate(cwd, '/.', '--') AS key, coalesce(cwd = '/w/proj1' OR starts_with(cwd, '/w/proj1/'), false) AS inside FROM rec")
def fn_project_scope(t):
    c = F.col("cwd")
    return t.rec.select("rid", names.project_key(c).alias("key"), F.coalesce(names.in_project(c, "/w/proj1"), F.lit(False)).alias("inside"))


@query("SELECT rid, CASE WHEN project IN ('proj1', 'proj4') THEN project END AS project, CASE WHEN project IN ('proj1', 'proj4') THEN cwd END AS cwd, CASE WHEN project IN ('proj1', 'proj4') THEN sid END AS sid FROM rec")
def fn_redact(t):
    allowed = F.col("project").isin("proj1", "proj4")
    return t.rec.select("rid", *[F.when(allowed, F.col(c)).alias(c) for c in ("project", "cwd", "sid")])


@query(f"SELECT rid, substr(sha256('{SALT}|' || sid), 1, 8) AS pseudonym FROM rec")
def fn_pseudonym(t):
    return t.rec.select("rid", names.pseudonym(SALT, F.col("sid")).alias("pseudonym"))


@query("SELECT event_id, CAST(round_even(resets_at / 60, 0) * 60 AS BIGINT) AS reset_min FROM samples")
def fn_reset_minute(t):
    from ..operators.quota import reset_minute

    return t.samples.select("event_id", reset_minute().alias("reset_min"))


@query("SELECT event_id, win, ts_us FROM samples WHERE NOT resets_at - ts_us / 1000000.0 > 8 * 86400")
def filter_placeholder_resets(t):
    from ..operators.quota import is_placeholder

    return t.samples.where(~is_placeholder()).select("event_id", "win", "ts_us")


@query("SELECT event_id, win, used_pct, CAST(round_even(resets_at / 60, 0) * 60 AS BIGINT) AS reset_min FROM samples WHERE used_pct IS NOT NULL AND resets_at IS NOT NULL AND resets_at > ts_us / 1000000.0 AND resets_at - ts_us / 1000000.0 <= 8 * 86400")
def filter_sample_admission(t):
    from ..operators.quota import admitted, reset_minute

    return t.samples.where(admitted()).select("event_id", "win", "used_pct", reset_minute().alias("reset_min"))


@query(f"SELECT event_id, CASE WHEN resets_at <= {NOW} / 1000000.0 THEN 0.0 ELSE used_pct END AS used_pct, CASE WHEN resets_at > {NOW} / 1000000.0 THEN resets_at END AS resets_at FROM samples")
def fn_adjust_passed_resets(t):
    from ..operators.quota import adjust_passed

    return adjust_passed(t.samples, NOW).select("event_id", "used_pct", "resets_at")


@query(f"SELECT event_id, CASE WHEN resets_at <= {NOW} / 1000000.0 THEN resets_at ELSE resets_at - span_s END AS starts_at FROM samples")
def fn_window_start(t):
    from ..operators.quota import window_start

    return t.samples.select("event_id", window_start(F.col("resets_at"), F.col("span_s"), NOW).alias("starts_at"))
