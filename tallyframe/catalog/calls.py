"""Dedup, pricing, filters and scans over the record table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import DAY, NOW
from ..functions.money import usd
from ..functions.names import is_free, is_pseudo
from ..operators import dedup, pricing
from ..operators.asof import small
from ..registry import query

IDENT = """CASE WHEN dk IS NOT NULL AND dk <> '' THEN 'k|' || dk
  WHEN coalesce(mid, '') = '' AND input_tokens + output_tokens + cache_create + cache_read = 0 THEN NULL
  ELSE 'f|' || coalesce(mid,'') || '|' || coalesce(sid,'') || '|' || ts_us || '|' || model || '|' || input_tokens || '|' || output_tokens || '|' || cache_create || '|' || cache_read END"""
#: Files of which only the records are left.
ORPHAN = "file_path IN ('/p/3.jsonl', '/p/11.jsonl')"
SLIM = ("rid", "machine_id", "file_path", "account_uuid", "model", "ts_us", "day", "sid", "project", "dk")
SLIM_SQL = ", ".join(SLIM)


@query(f"""WITH x AS (SELECT *, {IDENT} AS ident, ({ORPHAN}) AS is_orphan FROM rec)
SELECT {SLIM_SQL} FROM x WHERE ident IS NULL UNION ALL
SELECT {SLIM_SQL} FROM x WHERE ident IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ident ORDER BY is_orphan, file_path, rid) = 1""")
def dedup_first_wins(t):
    marked = t.rec.withColumn("is_orphan", F.col("file_path").isin("/p/3.jsonl", "/p/11.jsonl"))
    return dedup.dedup_first_wins(marked, ["is_orphan", "file_path", "rid"]).select(*SLIM)


@query(f"SELECT {SLIM_SQL} FROM kept")
def dedup_merged(t):
    return dedup.dedup_merged(t.rec).select(*SLIM)


@query("SELECT rid, coalesce(dk, '') <> '' AND rid <> min(rid) OVER (PARTITION BY account_uuid, dk) AS is_dup FROM rec")
def dedup_flag_full(t):
    return dedup.dedup_flag(t.rec).select("rid", "is_dup")


@query("SELECT rid, coalesce(dk, '') <> '' AND rid <> min(rid) OVER (PARTITION BY account_uuid, dk) AS is_dup FROM rec")
def dedup_flag_incremental(t):
    stored = dedup.dedup_flag(t.rec.where("machine_id <> 'm2'"))
    return dedup.dedup_flag_incremental(stored, t.rec.where("machine_id = 'm2'")).select("rid", "is_dup")


@query(f"""WITH m AS (SELECT * FROM rec WHERE machine_id = 'm1')
SELECT {SLIM_SQL} FROM m WHERE coalesce(dk, '') = '' UNION ALL
SELECT {SLIM_SQL} FROM m WHERE dk <> '' QUALIFY row_number() OVER (PARTITION BY account_uuid, dk ORDER BY rid) = 1""")
def dedup_machine_scope(t):
    return dedup.dedup_merged(t.rec.where("machine_id = 'm1'")).select(*SLIM)


@query("SELECT rid, effective, round(CAST(ri AS DOUBLE) * 1000000, 6) AS input_per_million, round(CAST(ri2 AS DOUBLE) * 1000000, 6) AS tier_per_million FROM rec LEFT JOIN price_dim d ON rec.model = d.model AND ts_us >= d.from_us AND ts_us < d.to_us")
def asof_price(t):
    p = pricing.asof_price(t.rec, t.price_dim)
    return p.select("rid", "effective", F.round(F.col("ri").cast("double") * 1000000, 6).alias("input_per_million"), F.round(F.col("ri2").cast("double") * 1000000, 6).alias("tier_per_million"))


@query("SELECT rid, model, round(CAST(computed AS DOUBLE), 6) AS computed FROM calls")
def price_records(t):
    return t.calls.select("rid", "model", usd(F.col("computed")).alias("computed"))


@query("SELECT rid, log_cost IS NOT NULL AS logged, round(CAST(cost AS DOUBLE), 6) AS cost FROM calls")
def price_effective_cost(t):
    return t.calls.select("rid", F.col("log_cost").isNotNull().alias("logged"), usd(F.col("cost")).alias("cost"))


@query("""SELECT rid, round(CAST(CASE WHEN input_tokens > 200000 AND ri2 IS NOT NULL THEN 200000 * ri + (input_tokens - 200000) * ri2 ELSE input_tokens * ri END AS DOUBLE), 6) AS input_cost
FROM rec JOIN price_dim d ON rec.model = d.model AND ts_us >= d.from_us AND ts_us < d.to_us""")
def fn_tiered_cost(t):
    from ..functions.money import tiered_cost

    p = pricing.asof_price(t.rec, t.price_dim).where("ri IS NOT NULL")
    return p.select("rid", usd(tiered_cost(F.col("input_tokens"), F.col("ri"), F.col("ri2"))).alias("input_cost"))


@query(f"SELECT {SLIM_SQL} FROM rec WHERE ts_us >= {NOW - 5 * DAY} AND ts_us < {NOW}")
def scan_ts_range(t):
    return t.rec.where((F.col("ts_us") >= NOW - 5 * DAY) & (F.col("ts_us") < NOW)).select(*SLIM)


@query(f"SELECT {SLIM_SQL} FROM rec WHERE starts_with(file_path, '/p/1')")
def scan_path_prefix(t):
    return t.rec.where(F.col("file_path").startswith("/p/1")).select(*SLIM)


@query(f"SELECT {SLIM_SQL} FROM rec WHERE ts_us >= 1704844800000000 AND ts_us <= 1705276800000000")
def filter_local_range(t):
    """Both ends belong to the range; the end is the last day's own midnight."""
    low, high = (F.unix_micros(F.to_timestamp(F.lit(d))) for d in ("2024-01-10", "2024-01-15"))
    return t.rec.where((F.col("ts_us") >= low) & (F.col("ts_us") <= high)).select(*SLIM)


@query(f"SELECT {SLIM_SQL} FROM kept WHERE ts_us >= 1704844800000000 AND ts_us < 1705276800000000")
def filter_merged_range(t):
    low, high = (F.unix_micros(F.to_timestamp(F.lit(d))) for d in ("2024-01-10", "2024-01-15"))
    return dedup.dedup_merged(t.rec).where((F.col("ts_us") >= low) & (F.col("ts_us") < high)).select(*SLIM)


@query(f"SELECT {SLIM_SQL} FROM rec WHERE contains(lower(project), 'oj1')")
def filter_substring(t):
    return t.rec.where(F.lower("project").contains("OJ1".lower())).select(*SLIM)


@query(f"""SELECT {SLIM_SQL} FROM kept k WHERE EXISTS (SELECT 1 FROM project_aliases a WHERE a.alias = 'team' AND a.machine_id = k.machine_id AND a.project = k.project)
   OR (project = 'team')""")
def filter_by_alias(t):
    """By alias or by name; a row that matches both ways comes once."""
    named = t.project_aliases.where("alias = 'team'").select("machine_id", "project", F.lit(True).alias("named")).distinct()
    kept = dedup.dedup_merged(t.rec).join(small(named), ["machine_id", "project"], "left")
    return kept.where(F.col("named") | (F.col("project") == "team")).select(*SLIM)


@query(f"SELECT {SLIM_SQL} FROM kept WHERE project IS NOT NULL")
def filter_hide_redacted(t):
    return dedup.dedup_merged(t.rec).where("project IS NOT NULL").select(*SLIM)


@query(f"SELECT {SLIM_SQL} FROM kept WHERE project = 'proj4'")
def filter_entity_scope(t):
    return dedup.dedup_merged(t.rec).where("project = 'proj4'").select(*SLIM)


@query("""SELECT model, count(*) AS n FROM rec WHERE NOT EXISTS (SELECT 1 FROM price_dim d WHERE d.model = rec.model) AND NOT starts_with(model, '<') AND NOT contains(model, ':') GROUP BY 1
UNION ALL SELECT model, count(*) FROM rec WHERE starts_with(model, '<') GROUP BY 1""")
def filter_unpriced_models(t):
    """Models that no period names; free ones have no price and need none."""
    rest = t.rec.join(small(t.price_dim.select("model").distinct()), "model", "left_anti").where(~is_free(F.col("model")) | is_pseudo(F.col("model")))
    return rest.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {SLIM_SQL} FROM rec WHERE day BETWEEN '2024-01-08' AND '2024-01-14'")
def filter_period_records(t):
    """A time range a day wider on both sides prunes; the machine's own day decides."""
    low, high = 1704672000000000 - DAY, 1705276800000000 + DAY
    return t.rec.where((F.col("ts_us") >= low) & (F.col("ts_us") < high) & F.col("day").between("2024-01-08", "2024-01-14")).select(*SLIM)


@query("SELECT r.rid, i.file_path, i.archived FROM rec r JOIN inventory i USING (file_path)")
def join_record_file(t):
    return t.rec.join(small(t.inventory.select("file_path", "archived")), "file_path").select("rid", "file_path", "archived")


@query(f"SELECT machine_id, account_uuid, ts_us, spent_cents FROM extra WHERE ts_us >= {NOW - 31 * DAY} AND ts_us <= {NOW}")
def filter_retention_31d(t):
    return t.extra.where((F.col("ts_us") >= NOW - 31 * DAY) & (F.col("ts_us") <= NOW)).select("machine_id", "account_uuid", "ts_us", "spent_cents")
