"""Domain tables derived from the driver's tables, in Spark and, for the oracles, in DuckDB.

``Tables`` builds each table lazily as a DataFrame over ``events``; ``PRELUDE`` has the same
tables as common table expressions. Both come from one text with the dialect's few
functions filled in, so a query and its oracle start from equal rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: 2024-01-25T12:00:00Z, inside the events' range: queries never read the clock.
NOW = 1706184000000000
DAY = 86_400_000_000
HOUR = 3_600_000_000

_DUCK = {
    "TS": "epoch_us(ts)", "K": "CAST(json_extract_string(props, '$.k') AS BIGINT)", "DIV": "//",
    "day": lambda us: f"strftime(make_timestamp({us}), '%Y-%m-%d')", "copies": "unnest(CASE WHEN k % 5 = 0 OR k % 10 = 7 THEN [0, 1] ELSE [0] END)",
}
_SPARK = {
    "TS": "unix_micros(CAST(ts AS TIMESTAMP))", "K": "CAST(get_json_object(props, '$.k') AS BIGINT)", "DIV": "div",
    "day": lambda us: f"date_format(timestamp_micros({us}), 'yyyy-MM-dd')", "copies": "explode(CASE WHEN k % 5 = 0 OR k % 10 = 7 THEN array(0, 1) ELSE array(0) END)",
}


def _values(name: str, columns: str, rows: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) AS {name}({columns})"


def _tables(d: dict, events: str = "events") -> dict[str, str]:
    """Table name -> query text, in order of dependence."""
    day, div = d["day"], d["DIV"]
    offset = "CAST(CASE machine_id WHEN 'm1' THEN 3600 WHEN 'm2' THEN -18000 ELSE 0 END AS BIGINT)"
    return {
        "e": f"""SELECT event_id, {d['TS']} AS ts_us, CAST(ts AS DATE) AS day_utc, user_id, event_type,
            CAST(round(value * 100) AS BIGINT) AS cents, {d['K']} AS k FROM {events}""",
        "base": """SELECT event_id, event_id * 2 AS rid, concat('m', CAST(event_id % 3 AS STRING)) AS machine_id,
            concat('/p/', CAST(user_id % 20 AS STRING), '.jsonl') AS file_path,
            concat('acct-', CAST(user_id % 4 AS STRING)) AS account_uuid,
            concat('msg_', CAST(event_id AS STRING)) AS mid,
            CASE event_type WHEN 'click' THEN 'sonnet-x-20240101' WHEN 'view' THEN 'haiku-x'
              WHEN 'signup' THEN 'opus-x-20240101' WHEN 'purchase' THEN 'local:7b' ELSE '<synthetic>' END AS model,
            ts_us, concat('s-', CAST(user_id AS STRING), '-', CAST(day_utc AS STRING)) AS sid,
            CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 11 = 10 THEN 'team' ELSE concat('proj', CAST(user_id % 11 AS STRING)) END AS project,
            CASE WHEN k % 10 = 7 THEN NULL WHEN k % 50 = 3 THEN '' ELSE concat('msg_', CAST(event_id AS STRING), ':req_', CAST(k AS STRING)) END AS dk,
            CASE WHEN k % 8 = 0 THEN CAST(cents AS DECIMAL(18,0)) * CAST(0.001 AS DECIMAL(4,3)) END AS log_cost,
            cents * 10 AS input_tokens, k * 100 AS output_tokens, (event_id % 50) * 1000 AS cache_create,
            user_id * 3000 AS cache_read, user_id, k FROM e""",
        "copies": f"""SELECT event_id, rid + c AS rid, concat('m', CAST((event_id + c) % 3 AS STRING)) AS machine_id, file_path, account_uuid, mid, model,
              ts_us, sid, project, dk, log_cost, input_tokens, output_tokens, cache_create, cache_read, user_id, k
            FROM (SELECT *, {d['copies']} AS c FROM base) AS b""",
        "rec": f"""SELECT event_id, rid, machine_id, file_path, account_uuid, concat('label-', account_uuid) AS account_label,
            mid, model, ts_us, {day(f'ts_us + {offset} * 1000000')} AS day, {day('ts_us + 3600000000')} AS oslo_date,
            sid, project, CASE WHEN project IS NOT NULL AND k % 9 <> 0 THEN '/w/' || project || '/src' END AS cwd,
            CASE WHEN project IS NOT NULL AND k % 4 = 1 THEN 'git@host.example:team/' || project || '.git' END AS repo,
            dk, CAST(log_cost AS DECIMAL(30,10)) AS log_cost, input_tokens, output_tokens, cache_create, cache_read,
            CAST(1 AS BIGINT) AS n_calls FROM copies""",
        "price_periods": _values("p", "ord, effective, from_us, pm, ri, ro, rc, rr, ri2, ro2, rc2, rr2", ", ".join(
            f"({o}, '{eff}', {us}, '{pm}', " + ", ".join(f"CAST({x} AS DECIMAL(14,10))" for x in rates) + ")"
            for o, eff, us, pm, rates in (
                (1, "2024-01-01", 1704067200000000, "sonnet-x", ("0.000003", "0.000015", "0.00000375", "0.0000003", "0.000006", "0.0000225", "0.0000075", "0.0000006")),
                (2, "2024-01-01", 1704067200000000, "haiku-x", ("0.000001", "0.000005", "0.00000125", "0.0000001", "NULL", "NULL", "NULL", "NULL")),
                (3, "2024-01-10", 1704844800000000, "opus-x-20240101", ("0.000005", "0.000025", "0.00000625", "0.0000005", "NULL", "NULL", "NULL", "NULL")),
                (4, "2024-01-15T18", 1705341600000000, "sonnet-x-20240101", ("0.000003", "0.000015", "0.00000375", "0.0000003", "NULL", "NULL", "NULL", "NULL")),
            ))),
        "plan_prices": _values("p", "kind, name, from_us, usd", """
            ('seats', 'team', 1704067200000000, CAST(30 AS DECIMAL(10,2))), ('plans', 'pro', 1704067200000000, CAST(20 AS DECIMAL(10,2))),
            ('plans', 'max_5x', 1704067200000000, CAST(100 AS DECIMAL(10,2))), ('plans', 'max_20x', 1704067200000000, CAST(200 AS DECIMAL(10,2))),
            ('plans', 'max_5x', 1705708800000000, CAST(110 AS DECIMAL(10,2))), ('seats', 'team', 1705708800000000, CAST(35 AS DECIMAL(10,2)))"""),
        "account_events": """SELECT concat('m', CAST(event_id % 3 AS STRING)) AS machine_id, ts_us, concat('acct-', CAST(user_id % 4 AS STRING)) AS account_uuid,
            CASE WHEN k = 4 THEN NULL WHEN user_id % 4 = 1 THEN 'b@x.example' WHEN user_id % 4 = 3 THEN 'c@x.example' ELSE 'a@x.example' END AS email,
            CASE WHEN k <> 4 THEN concat('org-', CAST(user_id % 4 AS STRING)) END AS organization_uuid,
            CASE WHEN k <> 4 THEN concat('Org ', CAST(user_id % 4 AS STRING)) END AS organization_name,
            CASE WHEN k = 1 THEN 'team' END AS seat_tier, CASE WHEN k = 2 THEN 'max_5x' END AS user_tier, CASE WHEN k <> 3 THEN 'pro' END AS org_tier,
            CASE WHEN k = 0 THEN 'backfill' ELSE 'capture' END AS source FROM e WHERE event_type = 'signup' AND k < 5""",
        "account_tiers": """SELECT concat('acct-', CAST(user_id % 4 AS STRING)) AS account_uuid, ts_us AS from_us, CASE WHEN k = 0 THEN 'team' END AS seat_tier,
            CASE WHEN k = 1 THEN 'max_5x' WHEN k = 2 THEN 'max_20x' END AS user_tier, CASE WHEN k <> 2 THEN 'pro' END AS org_tier
            FROM e WHERE event_type = 'purchase' AND k < 3""",
        "declared_timeline": """SELECT concat('m', CAST(event_id % 3 AS STRING)) AS machine_id, ts_us, 'acct-2' AS account_uuid, CAST(NULL AS STRING) AS email, CAST(NULL AS STRING) AS organization_uuid,
            CAST(NULL AS STRING) AS organization_name, CAST(NULL AS STRING) AS seat_tier, 'max_5x' AS user_tier, CAST(NULL AS STRING) AS org_tier, 'backfill' AS source
            FROM e WHERE event_type = 'signup' AND user_id % 4 = 2 AND k < 10""",
        "declared_accounts": """SELECT event_id AS n, CASE WHEN k % 3 = 0 THEN concat('acct-', CAST(user_id % 6 AS STRING)) END AS uuid,
            CASE WHEN k % 3 = 1 THEN CASE user_id % 4 WHEN 1 THEN 'b@x.example' WHEN 3 THEN 'c@x.example' ELSE 'a@x.example' END END AS mail FROM e WHERE event_type = 'signup'""",
        "fx_observations": """SELECT event_id, CAST(day_utc AS STRING) AS date, CAST(4 + cents % 2000 AS DOUBLE) / 50 AS rate FROM e""",
        "project_rules": _values("r", "id, match_kind, match_value, target", """
            (1, 'name', 'proj1', 'merged'), (2, 'name', 'proj2', 'merged'), (3, 'cwd_prefix', '/w/proj3', 'merged'),
            (4, 'remote', 'host.example/team/proj5', 'remote-five'), (5, 'name', 'proj3', 'never-reached')"""),
        "project_aliases": _values("r", "machine_id, project, alias", "('m0', 'proj4', 'team'), ('m1', 'proj5', 'team'), ('m0', 'team', 'team')"),
        "account_aliases": _values("r", "account_uuid, alias", "('acct-1', 'work'), ('acct-3', 'work')"),
        "machines": _values("r", "machine_id, label", "('m0', 'desk'), ('m1', NULL), ('m2', 'laptop')"),
        "budgets": _values("r", "account_uuid, ceiling_usd, renewal_day", "('acct-0', CAST(500 AS DECIMAL(10,2)), 31), ('acct-1', NULL, 15)"),
        "plan_windows": _values("r", "account_uuid, win, applicable", """('acct-0', 'session', FALSE), ('acct-0', 'week', FALSE), ('acct-0', 'sonnet', FALSE), ('acct-0', 'scoped', FALSE),
            ('acct-1', 'sonnet', FALSE), ('acct-2', 'scoped', TRUE), ('acct-9', 'week', FALSE)"""),
        "window_spans": _values("r", "win, ord, span_s, family", "('session', 1, 18000, NULL), ('week', 2, 604800, NULL), ('sonnet', 3, 604800, 'sonnet'), ('scoped', 4, 604800, NULL)"),
        "samples": f"""SELECT machine_id, account_uuid, label AS account_label, win, CASE WHEN win = 'scoped' THEN CASE WHEN event_id % 2 = 0 THEN 'Opus' ELSE 'Sonnet' END END AS model,
            ts_us, CAST((sec % span_s) * 120 {div} span_s + event_id % 4 AS DOUBLE) AS used_pct,
            CASE WHEN k = 13 THEN CAST(9999999999 AS DOUBLE)
              ELSE CAST((sec {div} span_s) * span_s + span_s AS DOUBLE) + CAST((event_id % 5 - 2) * 4 AS DOUBLE) / 10 END AS resets_at,
            CASE WHEN win IN ('session', 'week') THEN 'stdin' ELSE 'api' END AS source, event_id, span_s
            FROM (SELECT event_id, k, machine_id, account_uuid, concat('label-', account_uuid) AS label, ts_us, ts_us {div} 1000000 AS sec,
              CASE k % 4 WHEN 0 THEN 'session' WHEN 1 THEN 'week' WHEN 2 THEN 'sonnet' ELSE 'scoped' END AS win,
              CASE WHEN k % 4 = 0 THEN 18000 ELSE 604800 END AS span_s FROM base) AS s""",
        "extra": f"""SELECT concat('m', CAST(event_id % 3 AS STRING)) AS machine_id, concat('acct-', CAST(user_id % 4 AS STRING)) AS account_uuid, ts_us, event_id,
            CAST(coalesce(sum(cents) OVER (PARTITION BY user_id % 4, ts_us {div} 864000000000 ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_cents
            FROM e WHERE event_type = 'purchase'""",
        "inventory": """SELECT file_path, count(*) * 1000 + max(event_id) AS mtime_ns, CAST(sum(input_tokens) AS BIGINT) AS size,
            CASE WHEN file_path LIKE '%7.jsonl' THEN 1 ELSE 0 END AS archived FROM base GROUP BY file_path""",
    }


def _fx(spark: bool) -> str:
    if spark:
        days, dow, dom, text = "explode(sequence(DATE'2023-12-20', DATE'2024-01-26'))", "weekday(d) + 1", "dayofmonth(d)", "date_format(d, 'yyyy-MM-dd')"
    else:
        days, dow, dom, text = "unnest(generate_series(DATE '2023-12-20', DATE '2024-01-26', INTERVAL 1 DAY))", "isodow(d)", "day(d)", "strftime(d, '%Y-%m-%d')"
    return f"""SELECT {text} AS date, CAST(10 AS DECIMAL(8,4)) + CAST({dow} AS DECIMAL(3,0)) * CAST(0.01 AS DECIMAL(3,2)) + CAST({dom} AS DECIMAL(3,0)) * CAST(0.001 AS DECIMAL(4,3)) AS rate
        FROM (SELECT {days} AS d) AS x WHERE {dow} <= 5 AND {dom} NOT IN (1, 17)"""


class Tables:
    """The domain tables over one directory of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def driver(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        texts = _tables(_SPARK) | {"fx_rates": _fx(True)}
        if name not in texts:
            raise AttributeError(name)
        if name not in self._made:
            text, sources = texts[name], {}
            if name == "e":
                text, sources = text.replace("FROM events", "FROM {events}"), {"events": self.driver("events")}
            for other in ("e", "base", "copies"):
                if f"FROM {other}" in text and other != name:
                    text = text.replace(f"FROM {other}", "FROM {%s}" % other)
                    sources[other] = getattr(self, other)
            self._made[name] = self.spark.sql(text, **sources) if sources else self.spark.sql(text)
        return self._made[name]

    @cached_property
    def calls(self) -> DataFrame:
        """Merged records after dedup, priced: the frame that most reports start from. Read from ``flagged``, without a shuffle."""
        return self.flagged.where("NOT is_dup").drop("is_dup")

    @cached_property
    def recomputed_calls(self) -> DataFrame:
        """The same from the records themselves: dedup and pricing at read."""
        from .operators.dedup import dedup_merged
        from .operators.pricing import price_calls

        return price_calls(dedup_merged(self.rec), self.price_dim)

    def _stored(self, name: str, build, partition_by: tuple[str, ...] = ()) -> DataFrame:
        from .operators.stored import stored

        return stored(self.spark, name, f"{self.sf_dir}/events.parquet", build, partition_by)

    @cached_property
    def price_dim(self) -> DataFrame:
        """The price in force by model and time, worked out once a session."""
        from .operators.pricing import price_intervals

        return self._stored("price_dim", lambda: price_intervals(self.base.select("model").distinct(), self.price_periods))

    @cached_property
    def flagged(self) -> DataFrame:
        """All records, priced, with the stored verdict on which are duplicates; by day."""
        from .operators.dedup import dedup_flag
        from .operators.pricing import price_calls

        return self._stored("flagged", lambda: price_calls(dedup_flag(self.rec), self.price_dim).hint("rebalance", "day"), ("day",))

    def rolled(self, cutoff: str) -> DataFrame:
        """The stored rollup of the days before ``cutoff``."""
        from .operators.maintenance import rollup

        return self._stored(f"rollup-{cutoff}", lambda: rollup(self.flagged.where(f"day < '{cutoff}' AND NOT is_dup")))


_COST = " + ".join(
    f"(CASE WHEN {c} > 200000 AND {r}2 IS NOT NULL THEN CAST(200000 AS DECIMAL(15,0)) * {r} + CAST({c} - 200000 AS DECIMAL(15,0)) * {r}2 ELSE CAST({c} AS DECIMAL(15,0)) * {r} END)"
    for c, r in (("input_tokens", "ri"), ("output_tokens", "ro"), ("cache_create", "rc"), ("cache_read", "rr"))
)

_DERIVED = {
    "kept": "SELECT * FROM rec WHERE coalesce(dk, '') = '' UNION ALL SELECT * FROM rec WHERE dk <> '' QUALIFY row_number() OVER (PARTITION BY account_uuid, dk ORDER BY rid) = 1",
    "price_hits": """SELECT model, p.*, row_number() OVER (PARTITION BY model, from_us ORDER BY (pm = model) DESC, ord) AS rn
        FROM (SELECT DISTINCT model FROM rec) m, price_periods p WHERE pm = model OR contains(model, pm) OR contains(pm, model)""",
    "price_dim": "SELECT *, coalesce(lead(from_us) OVER (PARTITION BY model ORDER BY from_us), 9223372036854775807) AS to_us FROM price_hits WHERE rn = 1",
    "calls": f"""SELECT k.*, d.effective, CASE WHEN contains(k.model, ':') THEN CAST(0 AS DECIMAL(30,10)) ELSE coalesce(CAST({_COST} AS DECIMAL(30,10)), CAST(0 AS DECIMAL(30,10))) END AS computed,
        coalesce(k.log_cost, CASE WHEN contains(k.model, ':') THEN CAST(0 AS DECIMAL(30,10)) ELSE CAST({_COST} AS DECIMAL(30,10)) END, CAST(0 AS DECIMAL(30,10))) AS cost,
        input_tokens + output_tokens + cache_create + cache_read AS tokens
        FROM kept k LEFT JOIN price_dim d ON k.model = d.model AND k.ts_us >= d.from_us AND k.ts_us < d.to_us""",
}


def prelude() -> str:
    every = _tables(_DUCK) | {"fx_rates": _fx(False)} | _DERIVED
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in every.items()) + "\n"


PRELUDE = prelude()
