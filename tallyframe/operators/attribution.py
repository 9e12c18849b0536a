"""Whose call it was: accounts by login time, tiers by change log, projects by rules, names by alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_remote
from .asof import asof_join, carried_forward, intervals, small


def event_labels(events: DataFrame) -> DataFrame:
    """Email; email and organization where one email has several; uuid without an email."""
    orgs = events.where(F.col("email").isNotNull()).groupBy("email").agg((F.count_distinct("organization_uuid") > 1).alias("__several"))
    several = F.coalesce("__several", F.lit(False))
    label = F.when(F.col("email").isNull(), F.col("account_uuid")).when(
        several & F.col("organization_name").isNotNull(), F.concat("email", F.lit(" ("), "organization_name", F.lit(")"))
    ).otherwise(F.col("email"))
    return events.join(small(orgs), "email", "left").withColumn("label", label).drop("__several")


def asof_account(records: DataFrame, events: DataFrame) -> DataFrame:
    """``login_uuid`` and ``login_label`` of the machine's newest event up to the call; unknown before the first."""
    log = event_labels(events).select("machine_id", F.col("account_uuid").alias("login_uuid"), F.col("label").alias("login_label"), F.col("ts_us").alias("from_us"))
    joined = asof_join(records, intervals(log, ["machine_id"]), ["machine_id"]).drop("from_us", "to_us")
    return joined.fillna("unknown", ["login_uuid", "login_label"])


def asof_tier(records: DataFrame, log: DataFrame, carry: bool, at: str) -> DataFrame:
    """The tier in force for the record's account; with ``carry``, nulls keep the account's last reading."""
    kept = log.select("account_uuid", "seat_tier", "user_tier", "org_tier", F.col(at).alias("from_us"))
    if carry:
        kept = carried_forward(kept, ["account_uuid"], ["seat_tier", "user_tier", "org_tier"], "from_us")
    return asof_join(records, intervals(kept, ["account_uuid"]), ["account_uuid"]).drop("from_us", "to_us")


def effective_tier() -> Column:
    return F.coalesce("user_tier", "org_tier")


def implied_name(project: Column, repo: Column, cwd: Column) -> Column:
    return F.when(repo.isNull() & cwd.isNull(), project)


#: Rules up to which they are tried one after the other in one expression.
FEW_RULES = 64


def _first_target(rules: list) -> Column:
    """What the first rule that fits says; null where none does."""
    out, begun = F, False
    for r in rules:
        v = r["match_value"]
        if r["match_kind"] == "name":
            fits = F.col("project") == v
        elif r["match_kind"] == "remote":
            fits = normalize_remote(F.col("repo")) == v
        elif r["match_kind"] == "cwd_prefix":
            fits = (F.col("cwd") == v) | F.col("cwd").startswith(f"{v}/")
        else:
            continue
        out, begun = out.when(fits, F.lit(r["target"])), True
    return out if begun else F.lit(None).cast("string")


def apply_rules(records: DataFrame, rules: DataFrame, few: int = FEW_RULES) -> DataFrame:
    """``target``: what the first matching rule says, else the project.

    Up to ``few`` rules are one conditional expression. More are tried on the distinct identities and
    the result is joined back: an identity states what a rule could match, its name, its remote and
    each folder above it, and meets the rules by equality.
    """
    listed = rules.select("id", "match_kind", "match_value", "target").limit(few + 1).collect()
    if len(listed) <= few:
        usable = sorted((r for r in listed if r["match_value"] is not None), key=lambda r: r["id"])
        return records.withColumn("target", F.coalesce(_first_target(usable), "project"))
    ids = records.select("project", "repo", "cwd").distinct()
    steps = F.split("cwd", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(F.lit("cwd_prefix").alias("match_kind"), F.array_join(F.slice(steps, 1, k), "/").alias("match_value")))
    named = F.array(
        F.struct(F.lit("name").alias("match_kind"), F.col("project").alias("match_value")),
        F.struct(F.lit("remote").alias("match_kind"), normalize_remote(F.col("repo")).alias("match_value")),
    )
    stated = ids.select("project", "repo", "cwd", F.inline(F.when(F.col("cwd").isNull(), named).otherwise(F.concat(named, folders))))
    first = stated.join(small(rules), ["match_kind", "match_value"]).groupBy("project", "repo", "cwd").agg(F.min_by("target", "id").alias("rule_target"))
    first = small(first.select(*[F.col(c).alias(f"__{c}") for c in ("project", "repo", "cwd")], "rule_target"))
    same = F.col("project").eqNullSafe(F.col("__project")) & F.col("repo").eqNullSafe(F.col("__repo")) & F.col("cwd").eqNullSafe(F.col("__cwd"))
    return records.join(first, same, "left").drop("__project", "__repo", "__cwd").withColumn("target", F.coalesce("rule_target", "project")).drop("rule_target")


def longest_prefix(rows: DataFrame, column: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """``rows`` with ``prefix``: the deepest folder of ``prefixes`` that is ``column`` or holds it, null where none does.

    A folder is met by equality with each folder above it, on the distinct folders, so the work is
    their depth and no pair is compared.
    """
    own = rows.select(F.col(column).alias("__own")).where(F.col(column).isNotNull()).distinct()
    steps = F.split("__own", "/")
    above = own.select("__own", F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth")).withColumn("__up", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    known = prefixes.select(F.rtrim(F.col(prefix), F.lit("/")).alias("__up"), F.col(prefix).alias("__name")).distinct()
    best = above.join(small(known), "__up").groupBy("__own").agg(F.max_by("__name", "depth").alias(prefix))
    return rows.join(small(best), F.col(column) == F.col("__own"), "left").drop("__own")


def display_names(records: DataFrame, account_aliases: DataFrame, project_aliases: DataFrame, machines: DataFrame) -> DataFrame:
    """``account``, ``shown_project`` and ``machine``; a hidden project is called after its account."""
    a = small(account_aliases.select("account_uuid", F.col("alias").alias("__a")))
    p = small(project_aliases.select("machine_id", "project", F.col("alias").alias("__p")))
    m = small(machines.select("machine_id", F.col("label").alias("__m")))
    x = records.join(a, "account_uuid", "left").join(p, ["machine_id", "project"], "left").join(m, "machine_id", "left")
    hidden = F.when(F.col("__a").isNotNull(), F.concat("__a", F.lit("-aggregated"))).otherwise(F.concat(F.coalesce("account_label", "account_uuid"), F.lit("/aggregated")))
    return x.withColumns({
        "account": F.coalesce("__a", "account_label", "account_uuid"),
        "shown_project": F.when(F.col("project").isNull(), hidden).otherwise(F.coalesce("__p", "project")),
        "machine": F.coalesce("__m", "machine_id"),
    }).drop("__a", "__p", "__m")
