"""Sharding by balanced label propagation.

Documents start in shards by rank, so that counts are at most one apart. Links are given as
(document, hub) memberships, which keeps a group of m copies at m rows instead of m^2 edges. In each
round the hubs that aren't settled look where their members are and ask for a shard; quotas, the
rows that a shard has left, decide who is granted; then the members of granted hubs move there:

* The first round is that of the large hubs, those with more than a ``SALTED``-th of a shard, of which
  there are at most ``SALTED`` times the shards. Each in turn of size takes the shard that holds most
  of its members among those with room. If that leaves one without room, all are dealt again, each to
  the shard that it fills best; a hub larger than any room left is cut there, and as seldom as possible.
* In the next round every other hub asks for the shard with most of its members, and a running total
  of sizes grants what the quota holds.
* In the rounds behind it those that were refused are laid end to end over the room that is left, the
  largest first, until all are settled or a round settles none.

Documents without links, and those of hubs that nothing could settle, fill the rest, so counts
stay at most one apart. A group is cut only if it is larger than a shard, if no packing was found
for the large ones, or if it is one of the few small ones that the last gaps can't hold. The rows
outside their hub's shard are logged.

Null texts have size 1 and are alike; repeated rows are copies like any other. For the work, the
rows of large hubs meet their shard by broadcast, so no key of a join holds more than a part of a
shard. An empty table gives an empty result; ties go to the shard that the hub's hash names first.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gapless_rank, materialize

N_SHARDS = 16
#: Hubs over this part of a shard are placed one by one; there are at most N_SHARDS x SALTED.
SALTED = 256
log = logging.getLogger(__name__)


def claims(sizes: dict[int, int], held: dict[int, dict[int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(hub, first, last, shard): where each large hub's members go, by their ranks; ``room`` is left as it is."""
    order = sorted(sizes, key=lambda h: (-sizes[h], h))
    most = max(room)

    def deal(choose) -> tuple[list[tuple[int, int, int, int]], int]:
        left, out, cuts = list(room), [], 0
        for hub in order:
            at = 0
            while at < sizes[hub]:
                n = sizes[hub] - at
                fits = [s for s, r in enumerate(left) if r >= n]
                # without room for all, as many as a whole shard or the largest gap takes
                s = choose(hub, n, fits, left) if fits else max(range(len(left)), key=lambda s: (left[s], -s))
                n = min(n, left[s])
                cuts += not fits and sizes[hub] <= most
                out.append((hub, at, at + n, s))
                left[s] -= n
                at += n
        return out, cuts

    tie = lambda hub, s: (hub * 2654435761 + s * 40503) % 65_521
    near, cuts = deal(lambda hub, n, fits, left: max(fits, key=lambda s: (held.get(hub, {}).get(s, 0), tie(hub, s))))
    if not cuts:
        return near
    tight, fewer = deal(lambda hub, n, fits, left: min(fits, key=lambda s: (left[s] - n, s)))
    return tight if fewer < cuts else near


def running_total(df: DataFrame, keys: list[str], order: str, size: str, out: str, per_bucket: int = 20_000) -> DataFrame:
    """The sum of ``size`` up to and with each row in order of ``order``'s hash, within each group, no group in one task. ``df`` is read three times."""
    n = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(per_bucket)), F.lit(1)).cast("long").alias("__n")
    dealt = df.crossJoin(F.broadcast(df.agg(n))).withColumn("__bucket", F.pmod(F.xxhash64(order), F.col("__n"))).drop("__n")
    sums = dealt.groupBy(*keys, "__bucket").agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = F.sum(size).over(Window.partitionBy(*keys, "__bucket").orderBy(order))
    return dealt.withColumn("__upto", inside).join(starts, [*keys, "__bucket"]).withColumn(out, F.col("__start") + F.col("__upto")).drop("__start", "__upto", "__bucket")


def _small_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A bounded table as one literal."""
    fields = [f.split() for f in schema.split(", ")]
    text = json.dumps([{name: v for (name, _), v in zip(fields, r)} for r in rows])
    kind = ",".join(f"{name}:{kind}" for name, kind in fields)
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{kind}>>")).alias("r")).select("r.*")


def _asked(members: DataFrame) -> DataFrame:
    """(hub, members, wish): the shard with most of a hub's members; ties by the hub's own order of shards."""
    held = members.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    order = F.pmod(F.xxhash64("hub", "shard"), F.lit(1 << 30))
    return held.groupBy("hub").agg(F.sum("n").alias("members"), F.max_by("shard", F.struct("n", order)).alias("wish"))


def _gap(first: Column, last: Column, room: list[int]) -> Column:
    """The shard whose stretch of the rooms, laid end to end and the largest first, holds [first, last); null where none does."""
    gaps, at = [], 0
    for s in sorted(range(len(room)), key=lambda s: (-room[s], s)):
        gaps.append({"s": s, "a": at, "z": at + room[s]})
        at += room[s]
    line = F.from_json(F.lit(json.dumps(gaps)), "array<struct<s:int,a:long,z:long>>")
    return F.try_element_at(F.filter(line, lambda g: (first >= g["a"]) & (last <= g["z"])), F.lit(1))["s"]


def _settled(hubs: DataFrame, room: list[int], rounds: int) -> tuple[DataFrame, list[int]]:
    """(hub, target) of the smaller hubs that quotas grant, and the room left; ``hubs`` has (hub, members, wish)."""
    spark = hubs.sparkSession
    quota = F.broadcast(_small_table(spark, list(enumerate(room)), "wish int, quota long"))
    asked = materialize(running_total(hubs, ["wish"], "hub", "members", "upto").join(quota, "wish"), "asked")
    fits = F.col("upto") <= F.col("quota")
    granted = asked.where(fits).select("hub", "members", F.col("wish").alias("target"))
    refused = materialize(asked.where(~fits).select("hub", "members"), "refused")
    left = list(room)
    every = granted
    for turn in range(rounds):
        for r in granted.groupBy("target").agg(F.sum("members").alias("n")).collect():  # one row a shard
            left[r["target"]] -= r["n"]
        waiting, rows = refused.agg(F.count(F.lit(1)), F.coalesce(F.sum("members"), F.lit(0))).first()
        log.info("round %d: %d groups with %d rows are not settled", turn + 1, waiting, rows)
        if not waiting:
            break
        laid = running_total(refused.withColumn("all", F.lit(0)), ["all"], "hub", "members", "upto").drop("all")
        met = materialize(laid.select("hub", "members", _gap(F.col("upto") - F.col("members"), F.col("upto"), left).alias("target")), "laid")
        granted, refused = met.where("target IS NOT NULL"), met.where("target IS NULL").select("hub", "members")
        every = every.unionByName(granted)
        if not granted.limit(1).count():
            break
    return every.select("hub", "target"), left


def balanced_labels(nodes: DataFrame, n_shards: int = N_SHARDS, rounds: int = 8) -> DataFrame:
    """``nodes`` (node, copy, hub, ...) with a ``shard``: row counts at most one apart.

    (node, copy) tells rows apart; a null hub is no link. Each round is written to the shared folder.
    """
    spark, columns = nodes.sparkSession, nodes.columns
    ranked = gapless_rank(nodes.withColumn("__all", F.lit(0)), ["__all"], ["node", "copy"], "rank").drop("__all")
    start = materialize(ranked.withColumn("shard", F.pmod("rank", F.lit(n_shards)).cast("int")).drop("rank"), "state")
    total = start.count()
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    hubs = materialize(_asked(start.where(F.col("hub").isNotNull())).where("members > 1"), "hubs")
    is_large = F.col("members") * SALTED > room[-1]
    large = hubs.where(is_large).select("hub")  # at most n_shards x SALTED
    held: dict[int, dict[int, int]] = {}
    for r in start.join(F.broadcast(large), "hub").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n")).collect():
        held.setdefault(r["hub"], {})[r["shard"]] = r["n"]
    sizes = {h: sum(x.values()) for h, x in held.items()}
    placed = claims(sizes, held, room) if sizes else []
    for _, first, last, s in placed:
        room[s] -= last - first
    log.info("round 0: %d large groups, %d of them cut", len(sizes), len(placed) - len(sizes))
    split = {h for h, _, last, _ in placed if last < sizes[h]}
    whole = F.broadcast(_small_table(spark, [(h, s) for h, _, _, s in placed if h not in split], "hub long, target int"))
    parts = F.broadcast(_small_table(spark, [x for x in placed if x[0] in split], "hub long, first long, last long, target int"))
    moved = start.join(whole, "hub").drop("shard")
    if split:
        cut = materialize(start.join(F.broadcast(parts.select("hub").distinct()), "hub", "left_semi"), "cut")
        of = gapless_rank(cut, ["hub"], ["node", "copy"], "rank")
        moved = moved.unionByName(of.join(parts, "hub").where("rank >= first AND rank < last").drop("rank", "first", "last", "shard"))
    settled, room = _settled(hubs.where(~is_large), room, rounds)
    # no hub of these is hot; null hubs stay out of the join
    others = start.where(F.col("hub").isNotNull()).join(F.broadcast(large), "hub", "left_anti").join(settled, "hub", "left").drop("shard")
    rest = others.where("target IS NULL").unionByName(start.where(F.col("hub").isNull()).drop("shard"), allowMissingColumns=True).drop("target")
    moved = moved.unionByName(others.where("target IS NOT NULL")).select(*columns, F.col("target").alias("shard"))
    rest = materialize(rest.select(*columns), "rest")
    filled = gapless_rank(rest.withColumn("__all", F.lit(0)), ["__all"], ["node", "copy"], "rank").drop("__all")
    filled = filled.select(*columns, _gap(F.col("rank"), F.col("rank") + 1, room).alias("shard"))
    return materialize(moved.unionByName(filled), "state")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): equal texts are linked, shards hold equal counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.col("text").isNull().alias("absent"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
    )
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest")
    nodes = rows.select(key.alias("node"), F.monotonically_increasing_id().alias("copy"), F.xxhash64("digest", "absent").alias("hub"), "doc_id", "size", "text_crc32")
    state = balanced_labels(materialize(nodes, "documents"), n_shards, rounds)
    return gapless_rank(state, ["shard"], ["node", "copy"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
