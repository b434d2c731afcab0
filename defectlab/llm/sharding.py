"""Balanced label propagation: linked documents gather in one shard while every shard keeps its quota of rows.

Links are memberships ``(node, group)``: all members of a group are linked with
each other (an ordinary edge is a group of two), so a group of any size costs
one row per member and its votes one row, never a pair.

A round lets every linked row look at how its groups' members are spread over
the shards. It wants to go where most of them are, of equal shards to one with
room, then to the lowest, and never into a full one. How many may pass from one
shard to another is known from a count of at most ``shards ** 2`` numbers; who
passes goes by a hash. Each round is written to the shared folder. At the end
quotas are met exactly: rows above a shard's quota and rows without links fill
what others have free. Shard sizes differ by one row at most.

NULL texts or groups link nothing. Repeated rows are rows of their own. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectlab.llm.common import store

ROWS_PER_BUCKET = 50_000


def numbered(df: DataFrame, rows: int, part: Column, key: str) -> DataFrame:
    """Adds ``pos``: 0, 1, 2 ... within each part, without sorting a part in one task.

    Rows fall into buckets by a hash of ``key``, which must be unique; a bucket
    starts where the buckets before it end.
    """
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    placed = df.withColumns({"_part": part, "_bucket": F.pmod(F.xxhash64(key, F.lit(7)), F.lit(buckets))})
    sizes = placed.groupBy("_part", "_bucket").count()
    before = Window.partitionBy("_part").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part", "_bucket").orderBy(key)) - 1
    return placed.join(starts, ["_part", "_bucket"]).withColumn("pos", F.col("_start") + inside).drop("_part", "_bucket", "_start")


def _votes(members: DataFrame, state: DataFrame, shards: int) -> DataFrame:
    """For each node how many members of its groups, itself included, each shard holds."""
    spread = F.array(*[F.sum((F.col("shard") == s).cast("long")) for s in range(shards)])
    by_group = members.join(state, "node").groupBy("group").agg(spread.alias("spread"))
    total = F.array(*[F.sum(F.col("spread")[s]) for s in range(shards)])
    return members.join(by_group, "group").groupBy("node").agg(total.alias("votes"))


def passes(flow: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may pass between two shards: those that change places, and as many as the room takes, shared out by demand."""
    back = {(s, t): min(n, flow.get((t, s), 0)) for (s, t), n in flow.items() if s != t}
    found = dict(back)
    for t, free in enumerate(room):
        asking = sorted(((n - back[s, t], s) for (s, to), n in flow.items() if to == t and s != t), reverse=True)
        wanted, left = sum(n for n, _ in asking), max(0, free)
        for n, s in asking:
            given = min(n, left, -(-max(0, free) * n // max(1, wanted)))
            found[s, t] += given
            left -= given
    return found


def propagate(nodes: DataFrame, members: DataFrame, quotas: list[int], rounds: int = 12, seed: int = 1) -> tuple[DataFrame, list[int]]:
    """Labels for the linked ``nodes`` (column ``node``) and how many each shard then holds."""
    shards = len(quotas)
    state = nodes.select("node", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"))
    loads = [0] * shards
    for r in state.groupBy("shard").count().collect():
        loads[r["shard"]] = r["count"]
    for step in range(rounds):
        room = [q - n for q, n in zip(quotas, loads, strict=True)]
        open_to = F.array(*[F.lit(x > 0) for x in room])
        allowed = F.transform(
            "votes",
            lambda v, i: F.when(F.get(open_to, i), 2 * v + 1).when(i == F.col("shard"), 2 * v).otherwise(F.lit(-1).cast("long")),
        )
        wish = (F.array_position(allowed, F.array_max(allowed)) - 1).cast("int")
        wishes = state.join(_votes(members, state, shards), "node").withColumn("wish", wish).drop("votes")
        # Later on half of the nodes wait, so that two groups cannot change places for ever.
        moves = F.lit(True) if step < 6 else F.pmod(F.xxhash64("node", F.lit(seed + step)), F.lit(2)) == 0
        wishes = store(wishes.withColumn("wish", F.when(moves, F.col("wish")).otherwise(F.col("shard"))), "wishes")
        flow = {(r["shard"], r["wish"]): r["count"] for r in wishes.groupBy("shard", "wish").count().collect()}
        coming = [sum(n for (s, t), n in flow.items() if t == to and s != to) for to in range(shards)]
        if not any(coming):
            break
        passing = F.lit(0).cast("long")
        for (s, t), n in passes(flow, room).items():
            passing = F.when((F.col("shard") == s) & (F.col("wish") == t), F.lit(n)).otherwise(passing)
        stay = wishes.filter(F.col("wish") == F.col("shard")).select("node", "shard")
        moving = numbered(wishes.filter(F.col("wish") != F.col("shard")), sum(coming), F.col("shard") * shards + F.col("wish"), "node")
        moved = moving.select("node", F.when(F.col("pos") < passing, F.col("wish")).otherwise(F.col("shard")).alias("shard"))
        state = store(stay.unionByName(moved), "labels")
        loads = [0] * shards
        for r in state.groupBy("shard").count().collect():
            loads[r["shard"]] = r["count"]
    return state, loads


def shard(nodes: DataFrame, members: DataFrame, shards: int = 8, rounds: int = 12) -> DataFrame:
    """``nodes`` (column ``node``, unique) with ``shard`` and ``slot``, gapless within its shard.

    ``members`` has ``node`` and ``group`` for the linked nodes.
    """
    total = nodes.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    state, loads = propagate(members.select("node").distinct(), members, quotas, rounds)
    linked = numbered(state, sum(loads), F.col("shard"), "node")
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("shard") + 1)
    settled = linked.filter(F.col("pos") < quota).select("node", "shard", F.col("pos").alias("slot"))
    settled = store(settled, "settled")
    held = [min(n, q) for n, q in zip(loads, quotas, strict=True)]
    free = numbered(nodes.select("node").join(settled, "node", "left_anti"), total - sum(held), F.lit(0), "node")
    at, where, slot = 0, F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in range(shards):
        end = at + quotas[s] - held[s]
        here = (F.col("pos") >= at) & (F.col("pos") < end)
        where, slot = F.when(here, F.lit(s)).otherwise(where), F.when(here, F.col("pos") - at + held[s]).otherwise(slot)
        at = end
    filled = free.select("node", where.alias("shard"), slot.alias("slot"))
    return nodes.join(settled.unionByName(filled), "node")


def equal_text_links(nodes: DataFrame, digest: str = "digest") -> DataFrame:
    """Memberships of all rows that share a digest with another row."""
    shared = nodes.filter(F.col(digest).isNotNull()).groupBy(digest).count().filter("count > 1").select(F.col(digest).alias("group"))
    return nodes.select("node", F.col(digest).alias("group")).join(shared, "group")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, rounds: int = 12) -> DataFrame:
    """Shards whose row counts differ by one at most, equal texts together as far as quotas allow."""
    body = F.coalesce(F.col(text), F.lit(""))
    nodes = docs.select(
        F.monotonically_increasing_id().alias("node"),
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.md5(F.col(text)).alias("digest"),
    )
    nodes = store(nodes, "nodes")
    members = store(equal_text_links(nodes), "members")
    return shard(nodes, members, shards, rounds)
