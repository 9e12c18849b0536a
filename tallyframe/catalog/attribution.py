"""Accounts, tiers, projects and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution
from ..operators.asof import asof_join, intervals
from ..registry import query
from .scalars import REMOTE

LABELS = """lab AS (SELECT a.*, CASE WHEN email IS NULL THEN account_uuid WHEN (SELECT count(DISTINCT organization_uuid) FROM account_events b WHERE b.email = a.email) > 1 AND organization_name IS NOT NULL
 THEN email || ' (' || organization_name || ')' ELSE email END AS label FROM account_events a)"""
TARGET = f"""tgt AS (SELECT r.*, coalesce((SELECT arg_min(target, id) FROM project_rules p WHERE (match_kind = 'name' AND project = match_value) OR (match_kind = 'remote' AND {REMOTE} = match_value)
 OR (match_kind = 'cwd_prefix' AND (cwd = match_value OR starts_with(cwd, match_value || '/')))), project) AS target FROM rec r)"""


@query(f"WITH {LABELS} SELECT ts_us, account_uuid, label FROM lab")
def account_event_labels(t):
    return attribution.event_labels(t.account_events).select("ts_us", "account_uuid", "label")


@query(f"""WITH {LABELS}, iv AS (SELECT *, coalesce(lead(ts_us) OVER (PARTITION BY machine_id ORDER BY ts_us), 9223372036854775807) AS to_us FROM lab)
SELECT rid, coalesce(i.account_uuid, 'unknown') AS login_uuid, coalesce(label, 'unknown') AS login_label FROM rec r LEFT JOIN iv i ON r.machine_id = i.machine_id AND r.ts_us >= i.ts_us AND r.ts_us < i.to_us""")
def asof_account(t):
    return attribution.asof_account(t.rec, t.account_events).select("rid", "login_uuid", "login_label")


@query("""WITH c AS (SELECT account_uuid, ts_us, last_value(seat_tier IGNORE NULLS) OVER w AS seat_tier, last_value(user_tier IGNORE NULLS) OVER w AS user_tier, last_value(org_tier IGNORE NULLS) OVER w AS org_tier
 FROM account_events WINDOW w AS (PARTITION BY account_uuid ORDER BY ts_us ROWS UNBOUNDED PRECEDING)), iv AS (SELECT *, coalesce(lead(ts_us) OVER (PARTITION BY account_uuid ORDER BY ts_us), 9223372036854775807) AS to_us FROM c)
SELECT rid, seat_tier, coalesce(user_tier, org_tier) AS tier FROM rec r LEFT JOIN iv i ON r.account_uuid = i.account_uuid AND r.ts_us >= i.ts_us AND r.ts_us < i.to_us""")
def asof_tier_carried(t):
    return attribution.asof_tier(t.rec, t.account_events, True, "ts_us").select("rid", "seat_tier", attribution.effective_tier().alias("tier"))


@query("""WITH iv AS (SELECT *, coalesce(lead(from_us) OVER (PARTITION BY account_uuid ORDER BY from_us), 9223372036854775807) AS to_us FROM account_tiers)
SELECT rid, seat_tier, coalesce(user_tier, org_tier) AS tier FROM rec r LEFT JOIN iv i ON r.account_uuid = i.account_uuid AND r.ts_us >= i.from_us AND r.ts_us < i.to_us""")
def asof_tier_declared(t):
    return attribution.asof_tier(t.rec, t.account_tiers, False, "from_us").select("rid", "seat_tier", attribution.effective_tier().alias("tier"))


def tier_prices(t):
    """Intervals (kind, name, from_us, to_us, usd)."""
    return intervals(t.plan_prices, ["kind", "name"])


@query("""WITH iv AS (SELECT *, coalesce(lead(from_us) OVER (PARTITION BY account_uuid ORDER BY from_us), 9223372036854775807) AS to_us FROM account_tiers),
 pv AS (SELECT *, coalesce(lead(from_us) OVER (PARTITION BY kind, name ORDER BY from_us), 9223372036854775807) AS to_us FROM plan_prices)
SELECT rid, CAST(coalesce(s.usd, p.usd) AS DOUBLE) AS usd FROM rec r LEFT JOIN iv i ON r.account_uuid = i.account_uuid AND r.ts_us >= i.from_us AND r.ts_us < i.to_us
 LEFT JOIN pv s ON s.kind = 'seats' AND s.name = i.seat_tier AND r.ts_us >= s.from_us AND r.ts_us < s.to_us
 LEFT JOIN pv p ON p.kind = 'plans' AND p.name = coalesce(user_tier, org_tier) AND r.ts_us >= p.from_us AND r.ts_us < p.to_us""")
def price_tier_set(t):
    """The seat's price, else the plan's, at the time of the record."""
    x = attribution.asof_tier(t.rec.select("rid", "account_uuid", "ts_us"), t.account_tiers, False, "from_us").withColumn("tier", attribution.effective_tier())
    prices = tier_prices(t)
    for kind, key, out in (("seats", "seat_tier", "seat_usd"), ("plans", "tier", "plan_usd")):
        dim = prices.where(F.col("kind") == kind).select(F.col("name").alias(key), "from_us", "to_us", F.col("usd").alias(out))
        x = asof_join(x, dim, [key]).drop("from_us", "to_us")
    return x.select("rid", F.coalesce("seat_usd", "plan_usd").cast("double").alias("usd"))


@query(f"WITH {TARGET} SELECT rid, project, target FROM tgt")
def join_project_rules(t):
    return attribution.apply_rules(t.rec, t.project_rules).select("rid", "project", "target")


@query(f"WITH {TARGET} SELECT DISTINCT cwd FROM tgt WHERE target = 'merged' AND cwd IS NOT NULL")
def project_scope_members(t):
    """Every folder whose identity resolves to the same target."""
    ids = t.rec.select("project", "repo", "cwd").distinct()
    return attribution.apply_rules(ids, t.project_rules).where("target = 'merged' AND cwd IS NOT NULL").select("cwd").distinct()


@query("""SELECT rid, coalesce(a.alias, account_label, r.account_uuid) AS account, coalesce(label, r.machine_id) AS machine,
 CASE WHEN r.project IS NULL THEN CASE WHEN a.alias IS NOT NULL THEN a.alias || '-aggregated' ELSE coalesce(account_label, r.account_uuid) || '/aggregated' END ELSE coalesce(p.alias, r.project) END AS shown_project
FROM kept r LEFT JOIN account_aliases a ON a.account_uuid = r.account_uuid LEFT JOIN project_aliases p ON p.machine_id = r.machine_id AND p.project = r.project LEFT JOIN machines m ON m.machine_id = r.machine_id""")
def join_display_names(t):
    x = attribution.display_names(t.calls, t.account_aliases, t.project_aliases, t.machines)
    return x.select("rid", "account", "machine", "shown_project")


@query("""WITH known AS (SELECT DISTINCT account_uuid, email FROM account_events), one AS (SELECT email, min(account_uuid) AS u FROM known WHERE email IS NOT NULL GROUP BY 1 HAVING count(DISTINCT account_uuid) = 1)
SELECT n, coalesce((SELECT min(account_uuid) FROM known WHERE account_uuid = uuid), u) AS account_uuid FROM declared_accounts d LEFT JOIN one ON one.email = d.mail""")
def join_declared_accounts(t):
    """A declared entry finds its account by uuid, or by an email that only one account has; null is skipped and reported."""
    known = t.account_events.select("account_uuid", "email").distinct()
    one = known.where("email IS NOT NULL").groupBy("email").agg(F.count_distinct("account_uuid").alias("k"), F.min("account_uuid").alias("by_mail")).where("k = 1")
    ids = known.select(F.col("account_uuid").alias("by_uuid")).distinct()
    x = t.declared_accounts.join(ids, F.col("uuid") == F.col("by_uuid"), "left").join(one, F.col("mail") == F.col("email"), "left")
    return x.select("n", F.coalesce("by_uuid", "by_mail").alias("account_uuid"))
