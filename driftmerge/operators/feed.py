"""The change feed: every clock with its cell's present value, its site's id and its row's causal length."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmerge.functions import values as V
from driftmerge.functions.clock import RESTRICTED, TOMBSTONE

_TEXT = V.VALUE["s"].dataType


def feed(clocks: DataFrame, base: DataFrame, key: list[str], columns: list[str], sites: DataFrame | None = None) -> DataFrame:
    """Changes: key, col_name, col_value, col_version, db_version, site_id, cl, seq.

    cl is the sentinel's version, 1 without one. The value is null for sentinels and the literal RESTRICTED if the row can't
    be seen in base. base is joined by row, so each clock picks its value out of one joined row and nothing is unpivoted.
    sites (site_ord, site_id), if given, turns the clocks' ordinals into ids; it has a row for each replica, and Spark
    broadcasts it while it is small.
    """
    kinds = {f.name: f.dataType for f in base.schema}
    sentinel = clocks.where(F.col("col_name") == TOMBSTONE).select(*key, F.col("col_version").alias("_t"))
    there = base.select(*key, *(F.col(f"`{c}`").alias(f"_v{i}") for i, c in enumerate(columns)), F.lit(True).alias("_seen"))
    joined = clocks.join(sentinel, key, "left").join(there, key, "left")
    value = F.when(F.col("col_name") == TOMBSTONE, V.null_value()).when(F.col("_seen").isNull(), V.to_value(F.lit(RESTRICTED), _TEXT))
    for i, c in enumerate(columns):
        value = value.when(F.col("col_name") == c, V.to_value(F.col(f"_v{i}"), kinds[c]))
    out = joined.withColumn("col_value", value).withColumn("cl", F.coalesce("_t", F.lit(1)).cast("bigint"))
    if sites is not None:
        out = out.withColumnRenamed("site_id", "site_ord").join(sites, "site_ord", "left")
    return out.select(*key, "col_name", "col_value", "col_version", "db_version", "site_id", "cl", "seq")


def visible(changes: DataFrame) -> DataFrame:
    """Without cells whose rows can't be seen."""
    return changes.where(~F.col("col_value")["s"].eqNullSafe(F.lit(RESTRICTED)))


def since(db_version: int, seq: int) -> Column:
    """Condition: a change after the cursor."""
    return (F.col("db_version") > db_version) | ((F.col("db_version") == db_version) & (F.col("seq") > seq))


def local_only(changes: DataFrame, site_id) -> DataFrame:
    return changes.where(F.col("site_id") == F.lit(site_id))


def newest(changes: DataFrame) -> DataFrame:
    """One row, the greatest (db_version, seq) of all changes: the cursor once they are sent; zeros without changes."""
    best = F.max(F.struct("db_version", "seq"))
    return changes.agg(best.alias("c")).select(F.coalesce("c.db_version", F.lit(0)).cast("bigint").alias("db_version"), F.coalesce("c.seq", F.lit(0)).cast("bigint").alias("seq"))


def unsent(changes: DataFrame, site_id, sent: int) -> DataFrame:
    """One row: whether the newest local change is newer than what was sent."""
    last = F.coalesce(F.max(F.when(F.col("site_id") == F.lit(site_id), F.col("db_version"))), F.lit(0))
    return changes.agg((last > sent).alias("has_unsent"))


def ordered(changes: DataFrame) -> DataFrame:
    return changes.orderBy("db_version", "seq")


def glob(column: Column, pattern: str) -> Column:
    """Case-sensitive match of the whole text: * any run, ? one character, [...] and [^...] classes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^")) if c == "[" else -1
        if end > 0:
            inside = pattern[i + 1 : end]
            negated, inside = inside[:1] == "^", inside.removeprefix("^")
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]&^])", r"\\\1", inside) + "]")
            i = end
        else:
            out.append({"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or re.escape(c))
        i += 1
    return column.rlike("^" + "".join(out) + r"\z")


def like(column: Column, pattern: str) -> Column:
    """LIKE without regard to case."""
    return column.ilike(pattern)
