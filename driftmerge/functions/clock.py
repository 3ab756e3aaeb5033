"""Versions: row ids of changes, allocation of transaction versions, dense numbering, UUIDs of version 7."""

from __future__ import annotations

import secrets
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmerge.functions.staging import stage

#: Name of the column of a row's sentinel clock; its version is the causal length (odd: alive, even: deleted).
TOMBSTONE = "__[RIP]__"
#: Value of a cell whose row can't be seen.
RESTRICTED = "__[RLS]__"
SEQ_BITS = 30
VERSION = "0.8.12"


def row_id(db_version: Column, seq: Column) -> Column:
    """One 64-bit id of a change: the version above 30 bits of seq; null where seq takes more."""
    return F.when(seq.between(0, (1 << SEQ_BITS) - 1), F.shiftleft(db_version.cast("bigint"), SEQ_BITS).bitwiseOR(seq.cast("bigint")))


def row_id_version(rid: Column) -> Column:
    return F.shiftrightunsigned(rid, SEQ_BITS)


def row_id_seq(rid: Column) -> Column:
    return rid.bitwiseAND(F.lit((1 << SEQ_BITS) - 1))


def db_version(clocks: DataFrame, before_alter: int = 0) -> DataFrame:
    """One row: the newest version of all clocks, or that stored before an alteration if it is newer; 0 if there are none."""
    return clocks.agg(F.greatest(F.coalesce(F.max("db_version"), F.lit(0)), F.lit(before_alter)).cast("bigint").alias("db_version"))


def merged_version(local: Column, incoming: Column) -> Column:
    """Version that a merged change gets.

    Changes are applied in the order of their own versions, in which a running maximum is the change's version itself; so the
    next local version or the incoming one, whichever is greater, needs no window.
    """
    return F.greatest(local + 1, incoming)


def numbered(df: DataFrame, order: list, name: str = "seq", start: int = 0) -> DataFrame:
    """df with a dense number in the given order, without one task that sees all rows.

    Rows are dealt by ranges of the order and sorted in each; the counts of the ranges, as many rows as there are partitions,
    give each its first number. The ranges are staged, as sampling them anew could give others. Ties get numbers in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(dealt.groupBy(part.alias("part")).count().collect())  # a row for each shuffle partition at most
    first, total = {}, start
    for k, count in sizes:
        first[k], total = total, total + count
    if not first:
        return dealt.withColumn(name, F.lit(0).cast("bigint")).drop("_at")
    starts = F.create_map(*(F.lit(x).cast("bigint") for pair in first.items() for x in pair))
    return dealt.withColumn(name, F.element_at(starts, part) + inside).drop("_at")


def uuid7() -> bytes:
    """A new site's id: 48 bits of milliseconds, then random bits but for version and variant."""
    rest = secrets.randbits(80)
    high = (rest >> 64) & 0x0FFF | 0x7000
    low = rest & 0x3FFF_FFFF_FFFF_FFFF | 0x8000_0000_0000_0000
    return (time.time_ns() // 1_000_000).to_bytes(6, "big") + high.to_bytes(2, "big") + low.to_bytes(8, "big")


def uuid7_text(dashed: bool = True) -> Column:
    """A UUID of version 7 for each row, from the row's time and random bits; not deterministic."""
    millis = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    bits = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    plain = F.concat(millis, F.lit("7"), F.substring(bits, 14, 3), F.substring(bits, 17, 16))
    return uuid_text(plain) if dashed else plain


def uuid_text(plain: Column) -> Column:
    """32 hex digits with dashes."""
    return F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def version_number(version: str) -> tuple[int, ...]:
    """Comparable form of major.minor.patch."""
    return tuple(int(x) for x in version.split("."))


def compare_uuids(left: Column, right: Column) -> Column:
    """-1, 0 or 1 for two binary UUIDs of version 7: by time, then by their other bytes, which is the order of all their bytes."""
    return F.when(left == right, 0).when(left < right, -1).when(left > right, 1)
