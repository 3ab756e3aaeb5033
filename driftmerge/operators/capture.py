"""Local writes as clocks, a batch of writes being one transaction.

A clock has the key's columns, col_name, col_version, db_version, site_id and seq. Each function returns the clocks that a
batch writes (new ones, and new states of old ones); ``applied`` lays them over the clocks there were. seq counts the
operations of the batch: by key, and within a row in the order in which a single statement would have made them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmerge.functions.clock import TOMBSTONE, numbered

LOCAL = 0


def _op(order: int, name, version: Column) -> Column:
    return F.struct(F.lit(order).alias("op"), (name if isinstance(name, Column) else F.lit(name)).alias("col_name"), version.cast("bigint").alias("col_version"))


def _clocks(ops: DataFrame, key: list[str], db_version: int, site_id) -> DataFrame:
    """ops has the key and ``made``, an array of structs of _op or null."""
    found = ops.select(*key, F.explode(F.array_compact("made")).alias("x")).select(*key, "x.*")
    found = numbered(found, [*key, "op"])
    return found.select(*key, "col_name", "col_version", F.lit(db_version).cast("bigint").alias("db_version"), F.lit(site_id).alias("site_id"), "seq")


def _known(clocks: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Per key: version of the sentinel (t) and of each column (v0, v1, ...), null where there is none."""
    of = lambda name: F.max(F.when(F.col("col_name") == name, F.col("col_version")))
    return clocks.groupBy(*key).agg(of(TOMBSTONE).alias("t"), *(of(c).alias(f"v{i}") for i, c in enumerate(columns)))


def alive(version: Column) -> Column:
    """Next causal length of a row that is written: 1, or the next odd number."""
    return F.when(version.isNull(), 1).when(version % 2 == 0, version + 1).otherwise(version + 2)


def dead(version: Column) -> Column:
    """Next causal length of a row that is deleted."""
    return F.coalesce(version, F.lit(1)) + 1


def captured_inserts(new_keys: DataFrame, clocks: DataFrame, key: list[str], columns: list[str], db_version: int, site_id=LOCAL) -> DataFrame:
    """Rows that are new; a row of a table without value columns, or one that had a sentinel, writes its sentinel first."""
    ops = new_keys.select(*key).join(_known(clocks, key, columns), key, "left")
    sentinel = _op(0, TOMBSTONE, alive(F.col("t")))
    made = [sentinel if not columns else F.when(F.col("t").isNotNull(), sentinel)]
    made += [_op(i + 1, c, F.coalesce(F.col(f"v{i}"), F.lit(0)) + 1) for i, c in enumerate(columns)]
    return _clocks(ops.withColumn("made", F.array(*made)), key, db_version, site_id)


def captured_updates(before: DataFrame, after: DataFrame, clocks: DataFrame, key: list[str], columns: list[str], db_version: int, site_id=LOCAL) -> DataFrame:
    """Columns whose values differ between the two states of a row, nulls being equal."""
    old = before.select(*key, *(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(columns)))
    new = after.select(*key, *(F.col(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)))
    both = old.join(new, key)
    changed = F.lit(False)
    for i in range(len(columns)):
        changed = changed | ~F.col(f"o{i}").eqNullSafe(F.col(f"n{i}"))
    ops = both.where(changed).join(_known(clocks, key, columns), key, "left")
    made = [F.when(~F.col(f"o{i}").eqNullSafe(F.col(f"n{i}")), _op(i, c, F.coalesce(F.col(f"v{i}"), F.lit(0)) + 1)) for i, c in enumerate(columns)]
    return _clocks(ops.withColumn("made", F.array(*made)), key, db_version, site_id)


def captured_deletes(gone_keys: DataFrame, clocks: DataFrame, key: list[str], db_version: int, site_id=LOCAL) -> DataFrame:
    """A sentinel of even version for each deleted row; its other clocks go when it is applied."""
    ops = gone_keys.select(*key).join(_known(clocks, key, []), key, "left")
    return _clocks(ops.withColumn("made", F.array(_op(0, TOMBSTONE, dead(F.col("t"))))), key, db_version, site_id)


def captured_moves(moves: DataFrame, clocks: DataFrame, key: list[str], db_version: int, site_id=LOCAL) -> DataFrame:
    """Rows whose key changes; moves has the key's columns and the same ones with the prefix ``new_``.

    The old key gets a deleted sentinel, the row's cells come under the new key as local changes of version 1 in the order
    of their old clocks, and the new key gets a living sentinel.
    """
    new = [F.col(f"new_{k}").alias(k) for k in key]
    old_rows = moves.select(*key).join(_known(clocks, key, []), key, "left")
    removed = old_rows.select(*key, *(F.col(k).alias(f"s_{k}") for k in key), F.lit(0).alias("op"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(TOMBSTONE).alias("col_name"), dead(F.col("t")).cast("bigint").alias("col_version"))
    cells = moves.join(clocks.where(F.col("col_name") != TOMBSTONE), key)
    moved = cells.select(*new, *(F.col(k).alias(f"s_{k}") for k in key), F.lit(1).alias("op"), F.col("db_version").alias("a"), F.col("seq").alias("b"), "col_name", F.lit(1).cast("bigint").alias("col_version"))
    there = _known(clocks, key, []).select(*(F.col(k).alias(f"new_{k}") for k in key), "t")
    born = moves.join(there, [f"new_{k}" for k in key], "left")
    born = born.select(*new, *(F.col(k).alias(f"s_{k}") for k in key), F.lit(2).alias("op"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(TOMBSTONE).alias("col_name"), alive(F.col("t")).cast("bigint").alias("col_version"))
    found = numbered(removed.unionByName(moved).unionByName(born), [*(f"s_{k}" for k in key), "op", "a", "b", "col_name"])
    return found.select(*key, "col_name", "col_version", F.lit(db_version).cast("bigint").alias("db_version"), F.lit(site_id).alias("site_id"), "seq")


def backfilled(base: DataFrame, clocks: DataFrame, key: list[str], columns: list[str], db_version: int, site_id=LOCAL) -> DataFrame:
    """Clocks of version 1 for rows and columns that have none: of tables enabled with data, and of columns added since."""
    ops = base.select(*key).distinct().join(_known(clocks, key, columns).withColumn("_known", F.lit(True)), key, "left")
    made = [F.when(F.col(f"v{i}").isNull() & (F.col("t").isNull() | (F.col("t") % 2 == 1)), _op(i + 1, c, F.lit(1))) for i, c in enumerate(columns)]
    if not columns:
        made = [F.when(F.col("_known").isNull(), _op(0, TOMBSTONE, F.lit(1)))]
    return _clocks(ops.withColumn("made", F.array(*made)), key, db_version, site_id)


def applied(clocks: DataFrame, written: DataFrame, key: list[str]) -> DataFrame:
    """clocks after written: new states replace old ones, and a sentinel of even version ends the row's other clocks.

    Of two states of one clock the one of the greater (db_version, seq) holds.
    """
    both = clocks.select(*written.columns).unionByName(written)
    at = F.struct("db_version", "seq")
    last = both.groupBy(*key, "col_name").agg(F.max_by(F.struct("col_version", "db_version", "site_id", "seq"), at).alias("c")).select(*key, "col_name", "c.*")
    ended = last.where((F.col("col_name") == TOMBSTONE) & (F.col("col_version") % 2 == 0)).select(*key, F.struct("db_version", "seq").alias("_end"))
    rest = last.join(ended, key, "left").where((F.col("col_name") == TOMBSTONE) | F.col("_end").isNull() | (at > F.col("_end")))
    return rest.select(*written.columns)


def difference(before: DataFrame, after: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys that only after has, and keys that only before has: what a pair of snapshots says of inserts and deletes."""
    return after.select(*key).join(before.select(*key), key, "left_anti"), before.select(*key).join(after.select(*key), key, "left_anti")


def capture(before: DataFrame, after: DataFrame, clocks: DataFrame, key: list[str], columns: list[str], db_version: int, site_id=LOCAL, grow_only: bool = False) -> DataFrame:
    """Clocks after a transaction that took the table from before to after; key changes count as delete and insert.

    A grow-only table that lost or changed rows is an error.
    """
    inserted, gone = difference(before, after, key)
    updates = captured_updates(before, after, clocks, key, columns, db_version, site_id)
    if grow_only and not (gone.isEmpty() and updates.isEmpty()):
        raise ValueError("a grow-only table takes inserts only")
    out = clocks
    first = 0
    for written in (captured_deletes(gone, clocks, key, db_version, site_id), updates, captured_inserts(inserted, clocks, key, columns, db_version, site_id)):
        written = written.withColumn("seq", F.col("seq") + first)
        out = applied(out, written, key)
        first += written.count()
    return out
