"""Rollups, the archive, remainders and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import DAY, HOUR, NOW
from ..functions.money import usd
from ..operators import maintenance as m
from ..operators.asof import small
from ..operators.attribution import apply_rules, asof_account, longest_prefix
from ..operators.dedup import dedup_flag, dedup_merged
from ..operators.pricing import price_calls
from ..operators.rollups import StampedRollup
from ..operators.stored import shared_path
from ..registry import query
from .attribution import LABELS
from .report_queries import SUMS, _u

CUTOFF = "2024-01-15"
GONE = "file_path IN ('/p/3.jsonl', '/p/11.jsonl', '/p/16.jsonl')"
FOLD_US = NOW - 2 * DAY


@query(f"SELECT {', '.join(m.ROLLUP_KEYS)}, {SUMS}, min(ts_us) AS min_ts, max(ts_us) AS max_ts FROM calls WHERE day < '{CUTOFF}' GROUP BY {', '.join(m.ROLLUP_KEYS)}")
def rollup_build(t):
    return m.rollup(t.calls.where(F.col("day") < CUTOFF)).withColumn("cost", usd(F.col("cost")))


@query(f"SELECT day, {SUMS} FROM calls GROUP BY day")
def rollup_served_report(t):
    """The daily report from the stored rollup and the stored verdicts on recent calls: equal to the full path."""
    x = m.served(t.rolled(CUTOFF), t.flagged.where(~F.col("is_dup")), CUTOFF)
    out = x.groupBy("day").agg(*[F.sum(c).alias(c) for c in m.SUMS])
    return out.withColumn("cost", usd(F.col("cost")))


_LATE = "file_path IN ('/p/4.jsonl', '/p/13.jsonl') AND day >= '2024-01-18'"


def refreshed_rollup(t) -> tuple[StampedRollup, list[list[str]]]:
    """A rollup of all calls but those of two files, then once more when these came late, and once when nothing moved."""
    inputs = {"prices": t.price_periods, "logins": t.account_events, "rules": t.project_rules}
    fold = lambda calls: m.rollup(apply_rules(calls.where("NOT is_dup"), t.project_rules).withColumn("project", F.col("target")))
    columns = [*m.ROLLUP_KEYS, "cwd", "repo", "ts_us", "is_dup", *m.SUMS]
    kept = StampedRollup(t.spark, shared_path(t.spark, "stamped"))
    early = price_calls(dedup_flag(t.rec.where(f"NOT ({_LATE})")), t.price_dim).select(*columns)
    made = [kept.refresh(x, inputs, fold) for x in (early, t.flagged.select(*columns), t.flagged.select(*columns))]
    return kept, made


@query(f"""SELECT day, coalesce((SELECT arg_min(target, id) FROM project_rules p WHERE match_kind = 'name' AND project = match_value OR match_kind = 'remote' AND 'host.example/team/' || project = match_value AND repo IS NOT NULL
 OR match_kind = 'cwd_prefix' AND (cwd = match_value OR starts_with(cwd, match_value || '/'))), project) AS project, {SUMS} FROM calls GROUP BY ALL""")
def rollup_refreshed_report(t):
    """Cost by day and merged project from a rollup in which only the days of late files were made anew: equal to the full path."""
    kept, _ = refreshed_rollup(t)
    return kept.read().groupBy("day", "project").agg(*[F.sum(c).alias(c) for c in m.SUMS]).withColumn("cost", usd(F.col("cost")))


PLAN = f"""purged AS (SELECT * FROM rec WHERE {GONE}), live AS (SELECT dk FROM rec WHERE NOT {GONE} AND dk <> ''),
plan AS (SELECT file_path, count(*) AS n, CASE WHEN max(ts_us) >= {FOLD_US} THEN 'newer' WHEN count(DISTINCT account_uuid) > 1 THEN 'account change'
 WHEN count(*) FILTER (dk <> '' AND dk IN (SELECT dk FROM live)) > 0 THEN 'live copy' ELSE 'fold' END AS plan FROM purged WHERE ts_us < {FOLD_US} OR file_path = '/p/16.jsonl' GROUP BY 1)"""


def _purgeable(t):
    return t.rec.where(f"NOT ({GONE}) OR ts_us < {FOLD_US} OR file_path = '/p/16.jsonl'")


def _gone(t):
    return t.inventory.where(GONE).select("file_path")


@query(f"WITH {PLAN} SELECT * FROM plan")
def archive_plan(t):
    return m.archive_plan(_purgeable(t), _gone(t), FOLD_US)


_FOLD = f"""{PLAN}, folded AS (SELECT c.day, sid, project, cwd, repo, model, account_uuid, c.file_path, {SUMS}, min(ts_us) AS min_ts, max(ts_us) AS max_ts FROM calls c
 WHERE ts_us < {FOLD_US} AND c.file_path IN (SELECT file_path FROM plan WHERE plan = 'fold') GROUP BY 1, 2, 3, 4, 5, 6, 7, 8)"""


def _folded(t):
    plan = m.archive_plan(_purgeable(t), _gone(t), FOLD_US).where("plan = 'fold'")
    own = t.calls.where(F.col("ts_us") < FOLD_US).join(small(plan), "file_path", "left_semi")
    return m.rollup(own, m.ARCHIVE_KEYS)


@query(f"WITH {_FOLD} SELECT * FROM folded")
def archive_fold(t):
    return _folded(t).withColumn("cost", usd(F.col("cost")))


@query(f"""WITH {_FOLD}, {LABELS}, iv AS (SELECT *, coalesce(lead(ts_us) OVER (ORDER BY ts_us), 9223372036854775807) AS to_us FROM lab WHERE machine_id = 'm0')
SELECT f.day, f.sid, f.model, coalesce(i.account_uuid, 'unknown') AS login_uuid, coalesce((SELECT arg_min(target, id) FROM project_rules p WHERE match_kind = 'name' AND project = match_value OR match_kind = 'remote' AND 'host.example/team/' || project = match_value AND repo IS NOT NULL
 OR match_kind = 'cwd_prefix' AND (cwd = match_value OR starts_with(cwd, match_value || '/'))), project) AS target, f.cost, f.n_calls FROM folded f LEFT JOIN iv i ON f.min_ts >= i.ts_us AND f.min_ts < i.to_us""")
def archive_read(t):
    """Archived rows attributed at read: account by first time, rules on the raw project."""
    x = _folded(t).withColumns({"ts_us": F.col("min_ts"), "machine_id": F.lit("m0")})  # the archive is one machine's
    x = asof_account(apply_rules(x, t.project_rules), t.account_events)
    return x.select("day", "sid", "model", "login_uuid", "target", usd(F.col("cost")).alias("cost"), "n_calls")


#: Folders that are a project's own, some inside others; a file belongs to the deepest that holds it.
_PREFIXES = ("/p/w", "/p/w/proj1", "/p/w/proj1/src", "/p/w/proj3", "/p/w/proj", "/p/w/proj10/src/deeper")
_IN_PREFIX = "(SELECT arg_max(prefix, length(prefix)) FROM prefixes WHERE dir = prefix OR starts_with(dir, prefix || '/'))"
_DIRS = f"prefixes AS (SELECT unnest({list(_PREFIXES)}) AS prefix)"
_RULED = """coalesce((SELECT arg_min(target, id) FROM project_rules p WHERE match_kind = 'name' AND project = match_value OR match_kind = 'remote' AND 'host.example/team/' || project = match_value AND repo IS NOT NULL
 OR match_kind = 'cwd_prefix' AND (cwd = match_value OR starts_with(cwd, match_value || '/'))), project)"""


def _placed(t, rows):
    """Rows with the folder that a file was logged in, and the project folder it belongs to."""
    prefixes = t.spark.createDataFrame([(p,) for p in _PREFIXES], "dir_prefix string")
    return longest_prefix(rows.withColumn("dir", F.concat(F.lit("/p"), F.coalesce("cwd", F.lit("")))), "dir", prefixes, "dir_prefix")


def _orphan_sql() -> str:
    from ..fixtures import _COST

    return f"""{_FOLD}, {_DIRS}, left_ AS (SELECT * FROM rec WHERE {GONE} AND NOT (ts_us < {FOLD_US} AND file_path IN (SELECT file_path FROM plan WHERE plan = 'fold'))),
own AS (SELECT * FROM left_ WHERE coalesce(dk, '') = '' UNION ALL SELECT * FROM left_ WHERE dk <> '' QUALIFY row_number() OVER (PARTITION BY account_uuid, dk ORDER BY rid) = 1),
oc AS (SELECT k.*, coalesce(log_cost, CASE WHEN contains(k.model, ':') THEN CAST(0 AS DECIMAL(30,10)) ELSE coalesce(CAST({_COST} AS DECIMAL(30,10)), CAST(0 AS DECIMAL(30,10))) END) AS cost FROM own k LEFT JOIN price_dim d ON k.model = d.model AND k.ts_us >= d.from_us AND k.ts_us < d.to_us),
fx AS (SELECT day, sid, project, cwd, repo, model, account_uuid, c.file_path, sum(cost) AS cost, sum(n_calls) AS n_calls FROM calls c WHERE ts_us < {FOLD_US} AND c.file_path IN (SELECT file_path FROM plan WHERE plan = 'fold') GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
every AS (SELECT project, cwd, repo, cost, n_calls FROM oc WHERE cost <> 0 UNION ALL SELECT project, cwd, repo, cost, n_calls FROM fx WHERE cost <> 0),
keyed AS (SELECT project, cwd, repo, sum(cost) AS cost, sum(n_calls) AS n_calls, '/p' || coalesce(cwd, '') AS dir FROM every GROUP BY 1, 2, 3)"""


@query(f"WITH {_orphan_sql()} SELECT coalesce({_IN_PREFIX}, '') AS dir_prefix, {_RULED} AS target, cwd, repo, {_u('sum(cost)')} AS cost, CAST(sum(n_calls) AS BIGINT) AS n_calls FROM keyed GROUP BY ALL")
def agg_orphan_alltime(t):
    """All-time cost of what purged logs held, with the archive's rows on top: by project folder and identity, rules applied at read.

    The orphaned calls are deduplicated among themselves alone.
    """
    plan = m.archive_plan(_purgeable(t), _gone(t), FOLD_US).where("plan = 'fold'").select("file_path")
    lost = t.rec.where(GONE)
    left = lost.where(F.col("ts_us") >= FOLD_US).unionByName(lost.where(F.col("ts_us") < FOLD_US).join(small(plan), "file_path", "left_anti").select(*lost.columns))
    own = price_calls(dedup_merged(left), t.price_dim)
    keys = ["project", "cwd", "repo"]
    both = own.select(*keys, "cost", "n_calls").unionByName(_folded(t).select(*keys, "cost", "n_calls")).where("cost <> 0")
    keyed = both.groupBy(*keys).agg(F.sum("cost").alias("cost"), F.sum("n_calls").alias("n_calls"))
    x = _placed(t, apply_rules(keyed, t.project_rules)).withColumn("dir_prefix", F.coalesce("dir_prefix", F.lit("")))
    return x.groupBy("dir_prefix", "target", "cwd", "repo").agg(usd(F.sum("cost")).alias("cost"), F.sum("n_calls").alias("n_calls"))


@query(f"WITH {_DIRS}, d AS (SELECT DISTINCT '/p' || coalesce(cwd, '') AS dir FROM rec) SELECT dir, {_IN_PREFIX} AS dir_prefix FROM d")
def join_longest_prefix(t):
    """The deepest project folder that holds each folder."""
    return _placed(t, t.rec.select("cwd").distinct()).select("dir", "dir_prefix").distinct()


REST = """oth AS (SELECT * FROM rec r WHERE machine_id <> 'm0' AND (coalesce(dk, '') = '' OR NOT EXISTS (SELECT 1 FROM rec o WHERE o.machine_id = 'm0' AND o.dk = r.dk AND o.account_uuid = r.account_uuid))),
rest AS (SELECT * FROM oth WHERE coalesce(dk, '') = '' UNION ALL SELECT * FROM oth WHERE dk <> '' QUALIFY row_number() OVER (PARTITION BY account_uuid, dk ORDER BY rid) = 1),
rc AS (SELECT k.*, CASE WHEN contains(k.model, ':') THEN CAST(0 AS DECIMAL(30,10)) ELSE coalesce(CAST({cost} AS DECIMAL(30,10)), CAST(0 AS DECIMAL(30,10))) END AS computed FROM rest k LEFT JOIN price_dim d ON k.model = d.model AND k.ts_us >= d.from_us AND k.ts_us < d.to_us),
rp AS (SELECT *, coalesce(log_cost, computed) AS cost FROM rc)"""


def _rest_sql():
    from ..fixtures import _COST

    return REST.replace("{cost}", _COST)


def _rest(t):
    from ..operators.pricing import price_calls

    return price_calls(m.anti_remainder(t.rec, "m0"), t.price_dim)


@query(f"WITH {_rest_sql()} SELECT rid, machine_id, {_u('cost')} AS cost FROM rp")
def anti_remainder(t):
    return _rest(t).select("rid", "machine_id", usd(F.col("cost")).alias("cost"))


@query(f"WITH {_rest_sql()} SELECT ts_us // 60000000 * 60000000 AS minute_us, {_u('sum(cost)')} AS cost FROM rp WHERE ts_us > {NOW - 30 * DAY} AND ts_us <= {NOW} GROUP BY 1")
def remainder_minute_buckets(t):
    x = _rest(t).where((F.col("ts_us") > NOW - 30 * DAY) & (F.col("ts_us") <= NOW))
    return x.groupBy((F.floor(F.col("ts_us") / 60_000_000) * 60_000_000).cast("long").alias("minute_us")).agg(usd(F.sum("cost")).alias("cost"))


@query(f"WITH {_rest_sql()} SELECT machine_id, day, project, {_u('sum(cost)')} AS cost, CAST(sum(n_calls) AS BIGINT) AS n_calls FROM rp GROUP BY ALL")
def remainder_days(t):
    return _rest(t).groupBy("machine_id", "day", "project").agg(usd(F.sum("cost")).alias("cost"), F.sum("n_calls").alias("n_calls"))


_HOURS = (6, 12, 24, 168, 720)
_LOCAL = "m0"
# by the rule: a machine's minute buckets from each window's start on, all time from its day rows; a window without cost is 0
_PER = f"""{_rest_sql()}, per AS (SELECT machine_id, {", ".join(f"coalesce(sum(cost) FILTER (ts_us // 60000000 * 60000000 >= {NOW - h * HOUR} AND ts_us <= {NOW} AND ts_us > {NOW - 720 * HOUR}), 0) AS w{h}" for h in _HOURS)}, sum(cost) AS wall FROM rp GROUP BY 1),
remote AS ({" UNION ALL ".join(f"SELECT machine_id, '{n}' AS win, {c} AS cost FROM per" for n, c in [*((f"{h}h", f"w{h}") for h in _HOURS), ("all", "wall")])})"""


def _remote_windows(t):
    return m.remainder_windows(_rest(t), NOW, _HOURS)


@query(f"WITH {_PER} SELECT machine_id, win, {_u('cost')} AS cost FROM remote")
def remainder_windows(t):
    """Each other machine's rolling totals, from its minute buckets; all time from its day rows."""
    return _remote_windows(t).withColumn("cost", usd(F.col("cost")))


@query(f"""WITH {_PER}, pushed AS (SELECT machine_id, max(ts_us) AS seen FROM rec WHERE ts_us <= {NOW} GROUP BY 1),
own AS ({" UNION ALL ".join(f"SELECT '{n}' AS win, coalesce(sum(cost) FILTER ({w}), 0) AS cost FROM calls WHERE machine_id = '{_LOCAL}' AND ts_us <= {NOW}" for n, w in [*((f"{h}h", f"ts_us >= {NOW - h * HOUR}") for h in _HOURS), ("all", "true")])}),
o AS (SELECT win, sum(cost) AS cost, count(*) AS machines, min(seen) AS oldest FROM remote LEFT JOIN pushed USING (machine_id) GROUP BY 1)
SELECT own.win, {_u('own.cost + coalesce(o.cost, 0)')} AS cost, coalesce(machines, 0) AS machines, oldest AS oldest_us, coalesce({NOW} - oldest > 3600000000, false) AS stale FROM own LEFT JOIN o USING (win)""")
def windows_merged_remote(t):
    """Every window of this machine with the others' on top; stale when the machine that pushed longest ago did so over an hour ago."""
    pushed = t.rec.where(F.col("ts_us") <= NOW).groupBy("machine_id").agg(F.max("ts_us").alias("pushed_us"))
    own = m.own_windows(t.calls.where(F.col("machine_id") == _LOCAL), NOW, _HOURS)
    return m.merged_windows(own, _remote_windows(t), pushed, NOW).withColumn("cost", usd(F.col("cost")))


@query(f"""WITH {_rest_sql()} SELECT CAST(epoch_us(CAST(day AS TIMESTAMP)) + 43200000000 AS BIGINT) AS ts_us, day, coalesce(project, machine_id || '/aggregated') AS project, {_u('sum(cost)')} AS cost, CAST(sum(n_calls) AS BIGINT) AS n_calls FROM rp GROUP BY machine_id, day, project""")
def remainder_as_records(t):
    """Other machines' days as records at noon UTC; hidden projects go by the machine."""
    d = _rest(t).groupBy("machine_id", "day", "project").agg(F.sum("cost").alias("cost"), F.sum("n_calls").alias("n_calls"))
    noon = F.unix_micros(F.to_timestamp(F.concat("day", F.lit(" 12:00:00"))))
    return d.select(noon.alias("ts_us"), "day", F.coalesce("project", F.concat("machine_id", F.lit("/aggregated"))).alias("project"), usd(F.col("cost")).alias("cost"), "n_calls")


@query(f"WITH {_rest_sql()} SELECT {_u('sum(cost)')} AS cost, count(DISTINCT machine_id) AS machines FROM rp WHERE project IS NULL")
def remainder_not_shown(t):
    return _rest(t).where("project IS NULL").agg(usd(F.sum("cost")).alias("cost"), F.count_distinct("machine_id").alias("machines"))


@query("SELECT count(*) AS old_rows, count(log_cost) AS old_costs, count(*) FILTER (machine_id <> 'm2') AS new_rows, count(log_cost) FILTER (machine_id <> 'm2') AS new_costs, (count(*) >= 100 AND count(*) FILTER (machine_id <> 'm2') <= count(*) * 0.9) OR (count(log_cost) >= 100 AND count(log_cost) FILTER (machine_id <> 'm2') <= count(log_cost) * 0.9) AS suspicious FROM rec")
def quality_drop_check(t):
    return m.drop_check(t.rec, t.rec.where("machine_id <> 'm2'"))


@query("SELECT file_path, count(*) AS n FROM rec WHERE file_path NOT IN (SELECT file_path FROM inventory WHERE archived = 0) GROUP BY 1")
def quality_orphan_keys(t):
    known = t.inventory.where("archived = 0").select("file_path")
    return t.rec.join(small(known), "file_path", "left_anti").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def quality_content_stamp(t):
    """Changes when any input row does."""
    names = ("rec", "price_periods", "account_events", "project_rules")
    parts = [m.content_stamp(getattr(t, n), getattr(t, n).columns).withColumn("table_name", F.lit(n)) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"SELECT count(*) AS n, {_u('sum(cost)')} AS cost FROM calls WHERE ts_us < (SELECT min(ts_us) FROM account_events WHERE source = 'capture')")
def adopt_preview(t):
    """Calls from before the first capture, which an adoption would claim."""
    first = t.account_events.where("source = 'capture'").agg(F.min("ts_us").alias("first"))
    x = t.calls.join(F.broadcast(first), F.col("ts_us") < F.col("first"))
    return x.agg(F.count(F.lit(1)).alias("n"), usd(F.sum("cost")).alias("cost"))


@query("SELECT count(*) FILTER (cwd IS NULL AND repo IS NULL) AS n, count(*) AS of_all FROM rec")
def quality_signal_less(t):
    return t.rec.agg(F.count_if(F.col("cwd").isNull() & F.col("repo").isNull()).alias("n"), F.count(F.lit(1)).alias("of_all"))


@query(rf"""WITH {_FOLD}, {_DIRS} SELECT file_path, arg_min(coalesce(repo, ''), rid) AS repo, arg_min(coalesce(cwd, ''), rid) AS cwd, arg_min(coalesce(project, ''), rid) AS project FROM rec GROUP BY 1
UNION ALL SELECT DISTINCT {_IN_PREFIX} || '/#archived', coalesce(repo, ''), coalesce(cwd, ''), coalesce(project, '') FROM (SELECT *, '/p' || coalesce(cwd, '') AS dir FROM folded) AS a WHERE {_IN_PREFIX} IS NOT NULL""")
def agg_file_identities(t):
    """One identity a file, that of its first record; and the archive's, under a name of its own in the folder they were logged in."""
    names = ("repo", "cwd", "project")
    files = t.rec.groupBy("file_path").agg(*[F.min_by(F.coalesce(c, F.lit("")), "rid").alias(c) for c in names])
    archived = _placed(t, _folded(t)).where("dir_prefix IS NOT NULL").select(F.concat("dir_prefix", F.lit("/#archived")).alias("file_path"), *[F.coalesce(c, F.lit("")).alias(c) for c in names])
    return files.unionByName(archived.distinct())


