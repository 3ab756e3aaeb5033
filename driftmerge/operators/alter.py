"""Clocks after a change of a table's schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.functions.clock import TOMBSTONE
from driftmerge.operators.capture import applied, backfilled


def without_columns(clocks: DataFrame, columns: list[str]) -> DataFrame:
    """Only clocks of the columns there still are, and sentinels."""
    return clocks.where(F.col("col_name").isin([*columns, TOMBSTONE]))


def without_vanished(clocks: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """Without clocks of rows that base has no longer, but for sentinels of deleted rows."""
    grave = (F.col("col_name") == TOMBSTONE) & (F.col("col_version") % 2 == 0)
    seen = base.select(*key).distinct().withColumn("_seen", F.lit(True))
    return clocks.join(seen, key, "left").where(F.col("_seen").isNotNull() | grave).select(*clocks.columns)


def evolved(clocks: DataFrame, base: DataFrame, old_key: list[str], new_key: list[str], columns: list[str], db_version: int, site_id=0) -> DataFrame:
    """Clocks for base, which has the new schema. Rows have another identity under another key, so then all clocks are new."""
    if [k.lower() for k in old_key] != [k.lower() for k in new_key]:
        kept = backfilled(base, _none(base, new_key), new_key, columns, db_version, site_id)
        return kept
    kept = without_vanished(without_columns(clocks, columns), base, new_key)
    return applied(kept, backfilled(base, kept, new_key, columns, db_version, site_id), new_key)


def _none(base: DataFrame, key: list[str]) -> DataFrame:
    return base.where(F.lit(False)).select(*key, F.lit("").alias("col_name"), *(F.lit(0).cast("bigint").alias(c) for c in ("col_version", "db_version")), F.lit(0).alias("site_id"), F.lit(0).cast("bigint").alias("seq"))
