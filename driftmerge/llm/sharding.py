"""Shards by a consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only.

Each shard has ``vnodes`` points on a ring, and a key belongs to the next point clockwise from its own hash. A shard takes rows up
to its capacity; those over it continue clockwise to the next point whose shard still has room, and so on. With ``slack`` 0 the
capacities add up to the number of rows, so counts are at most one apart; with more slack fewer rows move when shards change.

Which rows go on is a matter of counts: the rows of each arc of the ring are in one order (by key hash), every step takes as
many from the front of the arc's rest as the shard has room for, and each step that turns rows away fills a shard, so there are
no more steps than shards. The plan is a range of places in the arc for each shard: a table of arcs x shards rows at most,
whatever the data. Rows get their places by a range sort, without a window over any one key, and their shards by a broadcast
join with the plan.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmerge.llm.common import stage

SHARDS = 8
VNODES = 64


def ring_position(key: Column) -> Column:
    """60 bits of the MD5 of a key's text; null has a place of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\0null"))), 1, 15), 16, 10).cast("bigint")


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in the order of the ring. A shard's points don't depend on other shards."""
    points = ((int(hashlib.md5(f"shard {s} point {v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(vnodes))
    return sorted(points)


def capacities(rows: int, points: list[tuple[int, int]], shards: int, slack: float) -> list[int]:
    """Rows that each shard may take: its even share, rounded up for those shards first on the ring that make up the total; with slack, more."""
    if slack > 0:
        return [-int(-rows * (1 + slack) // shards)] * shards
    first: list[int] = list(dict.fromkeys(s for _, s in points))
    return [rows // shards + (first.index(s) < rows % shards) for s in range(shards)]


def allocation(arcs: list[int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first, last + 1, shard, slot of the first) for the counts of rows in each arc."""
    room, plan, slots, n = list(room), [], [0] * len(room), len(points)
    waiting = [(arc, 0, count, arc) for arc, count in enumerate(arcs) if count]  # arc, places from and to, point it stands at
    while waiting:
        rest = []
        for arc, start, end, at in sorted(waiting, key=lambda w: (w[3], (w[3] - w[0]) % n)):
            shard = points[at][1]
            taken = min(room[shard], end - start)
            if taken:
                plan.append((arc, start, start + taken, shard, slots[shard]))
                slots[shard] += taken
                room[shard] -= taken
            if start + taken < end:
                rest.append((arc, start + taken, end, at))
        # On to the next point whose shard has room, and no farther: others may meet there.
        waiting = []
        for arc, start, end, at in rest:
            step = next(i for i in range(1, n + 1) if room[points[(at + i) % n][1]])
            waiting.append((arc, start, end, (at + step) % n))
    return plan


def sharded(docs: DataFrame, key: str, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (from 0, without gaps in each shard).

    A row's home depends on its key alone; equal keys start at one point and share its luck. Null is a key like any other.
    Rows in excess of a point's room are those whose rank hash is greatest, ties as they come in. An empty table gives an empty
    result; columns of docs named shard or slot are replaced.

    docs should be narrow: its rows are staged twice and shuffled once.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    points = ring(shards, vnodes)
    edges = F.array(*(F.lit(p) for p, _ in points))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), ring_position(F.col(f"`{key}`")).alias("at"))
    # Points at or after the position; past the last one the ring begins again.
    arc = F.size(F.filter(edges, lambda e: e < F.col("at"))) % len(points)
    rows = stage(rows.select("row", "at", arc.cast("int").alias("arc"), F.monotonically_increasing_id().alias("nth")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "arc", F.xxhash64("at", F.lit(1)), "nth").sortWithinPartitions("arc", F.xxhash64("at", F.lit(1)), "nth")
    dealt = stage(dealt.select("row", "arc", F.monotonically_increasing_id().alias("place")))
    part, inside = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    # A row for each pair of partition and arc that meet: partitions + arcs at most.
    met = dealt.groupBy(part.alias("part"), "arc").agg(F.min(inside).alias("low"), F.count(F.lit(1)).alias("n")).orderBy("arc", "part").collect()
    arcs, starts = [0] * len(points), []
    for r in met:
        starts.append((r.part, r.arc, arcs[r.arc] - r.low))  # place in the arc less place in the partition
        arcs[r.arc] += r.n
    plan = allocation(arcs, points, capacities(sum(arcs), points, shards, slack))
    begun = F.broadcast(spark.createDataFrame(starts, "part long, arc int, shift long"))
    ranges = F.broadcast(spark.createDataFrame(plan, "arc int, first long, stop long, shard int, base long"))
    placed = dealt.withColumn("part", part).join(begun, ["part", "arc"]).withColumn("nth", inside + F.col("shift"))
    placed = placed.join(ranges, "arc").where((F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("stop")))
    return placed.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), "shard", (F.col("base") + F.col("nth") - F.col("first")).alias("slot"))
