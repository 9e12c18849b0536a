"""Names and identities: models, repositories, projects, accounts, calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model families in the order in which they are looked for; the first that a name holds wins.
FAMILIES = ("haiku", "sonnet", "opus", "fable")


def model_family(model: Column, families: tuple[str, ...] = FAMILIES) -> Column:
    out = F.lit("other")
    for name in reversed(families):
        out = F.when(F.lower(model).contains(name), F.lit(name)).otherwise(out)
    return out


def short_model(model: Column, vendor: str = "claude-") -> Column:
    """Without the vendor's prefix and a date at the end."""
    return F.regexp_replace(F.regexp_replace(model, f"^{vendor}", ""), "-[0-9]{8}$", "")


def is_pseudo(model: Column) -> Column:
    return model.startswith("<") & model.endswith(">")


def is_free(model: Column) -> Column:
    return model.contains(":")


def dedup_identity() -> Column:
    """The call's own key, else what the copies share; null, never a duplicate, without id and tokens."""
    none = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_create") + F.col("cache_read") == 0
    bare = F.coalesce(F.col("mid"), F.lit(""))
    parts = [bare, F.coalesce(F.col("sid"), F.lit("")), *(F.col(c).cast("string") for c in ("ts_us", "model", "input_tokens", "output_tokens", "cache_create", "cache_read"))]
    return F.when(F.col("dk").isNotNull() & (F.col("dk") != ""), F.concat(F.lit("k|"), "dk")).when(
        (bare == "") & none, F.lit(None).cast("string")
    ).otherwise(F.concat(F.lit("f|"), F.concat_ws("|", *parts)))


def normalize_remote(remote: Column) -> Column:
    """host/path of an scp-like, ssh or https remote, without user, port and .git."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(remote), "^[A-Za-z+]+://", ""), "^[^@/]+@", "")
    return F.regexp_replace(F.regexp_replace(bare, "^([^/:]+):(?:[0-9]+/)?", "$1/"), "(\\.git)?/*$", "")


def last_part(path: Column) -> Column:
    """What follows the last slash, trailing slashes aside; null for an empty path."""
    name = F.regexp_extract(F.rtrim(path, F.lit("/")), "([^/]*)$", 1)
    return F.when(name != "", name)


def project_name(remote: Column, cwd: Column, roots: tuple[str, ...], fallback: Column) -> Column:
    """Remote's last part, else the folder under the deepest root, else the cwd's last part, else ``fallback``."""
    under = F.lit(None).cast("string")
    for root in sorted(roots, key=len):
        part = F.regexp_extract(cwd, f"^{root}/([^/]+)", 1)
        under = F.when(part != "", part).otherwise(under)
    return F.coalesce(last_part(normalize_remote(remote)), under, last_part(cwd), fallback)


def project_key(cwd: Column) -> Column:
    return F.translate(cwd, "/.", "--")


def in_project(path: Column, prefix: str) -> Column:
    """The folder itself, or anything below it."""
    return (path == prefix) | path.startswith(f"{prefix.rstrip('/')}/")


def pseudonym(salt: str, *values: Column, length: int = 8) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), *values), 256), 1, length)
