"""Merging changes of any number of replicas, as one aggregation.

A change is a cell's new value with the cell's version and the row's causal length (cl: odd alive, even deleted), or a sentinel
that states a causal length. Whatever the order of arrival, a row has the greatest causal length that any of its changes has;
of a column's changes at that length the greatest (version, value) holds. Both are maxima, so partial results combine before
the shuffle and a key of very many changes shuffles no more than a row per column and task.

Ties on version and value stay with the local change, and otherwise go by (site, db_version, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmerge.functions import values as V
from driftmerge.functions.clock import RESTRICTED, TOMBSTONE, merged_version
from driftmerge.plans.spec import Algo

#: Columns of a change besides those of its key.
CHANGE = ("col_name", "col_value", "col_version", "db_version", "site_id", "cl", "seq")


def _with_local(changes: DataFrame) -> DataFrame:
    return changes if "is_local" in changes.columns else changes.withColumn("is_local", F.lit(False))


def _rank(grow_only: bool) -> Column:
    """What changes of one cell are compared by; a grow-only set has no deletions, so causal lengths don't count there."""
    return F.struct((F.lit(1).cast("bigint") if grow_only else F.col("cl")).alias("cl"), "col_version", "col_value", "is_local", "site_id", "db_version", "seq")


def merged(changes: DataFrame, key: list[str], columns: list[str], algo: Algo = Algo.CLS, *more: Column) -> DataFrame:
    """One row per key: cl, the sentinel's change under ``sentinel`` and each column's best change under the column's name.

    A column's field is null if no change at the row's causal length names it; all are null for deleted rows. Columns that
    aren't named in ``columns`` only count for cl. Changes with a null key make up a row of their own. Empty in, empty out.
    more: further aggregates of a key's changes, under names of their own.
    """
    of = lambda name: F.max(F.when(F.col("col_name") == name, _rank(algo.grow_only)))
    cl = F.lit(1).cast("bigint") if algo.grow_only else F.max("cl")
    best = _with_local(changes).groupBy(*key).agg(cl.alias("cl"), of(TOMBSTONE).alias("sentinel"), *(of(c).alias(f"c{i}") for i, c in enumerate(columns)), *more)
    return _held(best, key, columns)


def _held(best: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """What merged() gives, of the greatest changes (sentinel, c0, c1 ...) and the causal length of each key."""
    alive = F.col("cl") % 2 == 1
    held = lambda name: F.when(F.col(name)["cl"] == F.col("cl"), F.col(name))
    made = {"cl", "sentinel", *key, *(f"c{i}" for i in range(len(columns)))}
    return best.select(*key, "cl", held("sentinel").alias("sentinel"), *(F.when(alive, held(f"c{i}")).alias(c) for i, c in enumerate(columns)), *(c for c in best.columns if c not in made))


def merged_rows(changes: DataFrame, key: list[str], columns: dict) -> DataFrame:
    """The same as merged() of row changes: rows that write all of ``columns`` (name to Spark type) at once.

    Such a row has the key, the columns' values as they are, and one stamp (col_version, db_version, site_id, cl, seq) for all of
    them. Values of one type are ordered as their VALUEs are, null first, so maxima are taken of the values themselves and become
    VALUEs afterwards. What is sorted before the shuffle is one narrow row for a row written, instead of a change for each column.
    """
    stamp = ("is_local", "site_id", "db_version", "seq")
    of = lambda c: F.max(F.struct("cl", "col_version", F.col(f"`{c}`").alias("v"), *stamp))
    best = _with_local(changes).groupBy(*key).agg(F.max("cl").alias("cl"), *(of(c).alias(f"c{i}") for i, c in enumerate(columns)))
    found = [F.struct(F.col(f"c{i}.cl").alias("cl"), F.col(f"c{i}.col_version").alias("col_version"), V.to_value(F.col(f"c{i}.v"), kind).alias("col_value"), *(F.col(f"c{i}.{x}").alias(x) for x in stamp)) for i, kind in enumerate(columns.values())]
    none = F.lit(None).cast(f"struct<cl: bigint, col_version: bigint, col_value: {V.VALUE.simpleString()}, is_local: boolean, site_id: {dict(changes.dtypes)['site_id']}, db_version: bigint, seq: bigint>")
    return _held(best.select(*key, "cl", none.alias("sentinel"), *(x.alias(f"c{i}") for i, x in enumerate(found))), key, list(columns))


def row_cells(changes: DataFrame, key: list[str], columns: dict) -> DataFrame:
    """The changes that row changes stand for, one for each row and column."""
    made = F.array(*(F.struct(F.lit(c).alias("col_name"), V.to_value(F.col(f"`{c}`"), kind).alias("col_value")) for c, kind in columns.items()))
    stamp = [c for c in CHANGE if c not in ("col_name", "col_value")]
    return changes.select(*key, *stamp, F.explode(made).alias("x")).select(*key, "x.*", *stamp).select(*key, *CHANGE)


def rows(state: DataFrame, key: list[str], columns: dict, defaults: dict | None = None) -> DataFrame:
    """The table that merged() stands for: alive rows, columns (name to Spark type) with defaults where nothing was written."""
    made = []
    for name, kind in columns.items():
        value = V.from_value(F.col(f"`{name}`.col_value"), kind)
        made.append(F.when(F.col(f"`{name}`").isNull(), F.lit((defaults or {}).get(name)).cast(kind)).otherwise(value).alias(name))
    return state.where("cl % 2 = 1").select(*key, *made)


def cells(state: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The changes that merged() has kept, as rows: the winning cells of alive rows, sentinels of all rows that have one."""
    one = lambda name: F.when(F.col(f"`{name}`").isNotNull(), F.struct(F.lit(TOMBSTONE if name == "sentinel" else name).alias("col_name"), F.col(f"`{name}`").alias("w")))
    found = state.select(*key, "cl", F.explode(F.array_compact(F.array(one("sentinel"), *(one(c) for c in columns)))).alias("x"))
    w = F.col("x.w")
    return found.select(*key, F.col("x.col_name").alias("col_name"), w["col_value"].alias("col_value"), w["col_version"].alias("col_version"), w["db_version"].alias("db_version"), w["site_id"].alias("site_id"), "cl", w["seq"].alias("seq"), w["is_local"].alias("is_local"))


def merge_changes(local: DataFrame, incoming: DataFrame, key: list[str], columns: list[str], local_version: int, algo: Algo = Algo.CLS) -> DataFrame:
    """Feed after applying incoming to local: cells(), where newly won changes have versions above local_version."""
    return merged_cells(merged_with(local, incoming, key, columns, algo), key, columns, local_version)


def merged_with(local: DataFrame, incoming: DataFrame, key: list[str], columns: list[str], algo: Algo = Algo.CLS) -> DataFrame:
    """merged() of local and incoming changes, and ``_local_cl``: the causal length that the row has locally, null without it."""
    both = local.withColumn("is_local", F.lit(True)).unionByName(incoming.withColumn("is_local", F.lit(False)))
    return merged(both, key, columns, algo, F.max(F.when(F.col("is_local"), F.col("cl"))).alias("_local_cl"))


def merged_cells(state: DataFrame, key: list[str], columns: list[str], local_version: int) -> DataFrame:
    """cells() of merged_with(), where newly won changes have versions above local_version."""
    won = cells(state, key, columns)
    version = F.when(F.col("is_local"), F.col("db_version")).otherwise(merged_version(F.lit(local_version), F.col("db_version")))
    return won.withColumn("db_version", version.cast("bigint"))


def unseen(local: DataFrame) -> DataFrame:
    """A feed whose cells of rows that can't be seen have no value, which is below every value, instead of the mark for it."""
    return local.withColumn("col_value", F.when(F.col("col_value")["s"].eqNullSafe(F.lit(RESTRICTED)), V.no_value()).otherwise(F.col("col_value")))


def upserted(base: DataFrame, state: DataFrame, key: list[str], columns: dict, defaults: dict | None = None, algo: Algo = Algo.CLS) -> DataFrame:
    """base after the changes of others in state, which is what merged_with() has made of base's own changes and those.

    Rows that no such change has won in stay as they are, with or without clocks. A row whose causal length has grown to an even
    number goes; one that comes back to life has defaults where nothing is written. A row that isn't in base is made if a change
    of another replica has won in it, as a row that was deleted without capture is.
    """
    theirs = lambda c: F.coalesce(~F.col(f"`{c}`.is_local"), F.lit(False))
    touched = theirs("sentinel")
    for c in columns:
        touched = touched | theirs(c)
    state = state.where(touched).select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(key)), "cl", "_local_cl", *(F.when(theirs(c), F.col(f"`{c}`.col_value")).alias(f"_w{i}") for i, c in enumerate(columns)))
    keys = [f"_k{i}" for i in range(len(key))]
    state = state.withColumn("_new", F.lit(False) if algo.grow_only else F.coalesce(F.col("cl") > F.col("_local_cl"), F.lit(True)))
    held = base.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(key)), *(F.col(f"`{c}`").alias(f"_v{i}") for i, c in enumerate(columns)), F.lit(True).alias("_there"))
    both = held.join(state, keys, "full").where("cl is null or cl % 2 = 1")
    made = []
    for i, (c, kind) in enumerate(columns.items()):
        default = F.lit((defaults or {}).get(c)).cast(kind)
        kept = F.when(F.col("_there").isNotNull() & ~F.coalesce("_new", F.lit(False)), F.col(f"_v{i}")).otherwise(default)
        made.append(F.when(F.col(f"_w{i}").isNotNull(), V.from_value(F.col(f"_w{i}"), kind)).otherwise(kept).alias(c))
    return both.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(key)), *made)


def rejected(changes: DataFrame, key: list[str], columns: list[str], algo: Algo = Algo.CLS) -> DataFrame:
    """The changes that lose: to a greater causal length, or to another change of their cell. Copies of a winner don't lose."""
    won = merged(changes, key, columns, algo)
    return _losing(_with_local(changes), won, key, columns).select(*changes.columns)


def _beside(changes: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """changes with the row of merged() that their key has, as ``won``: one join by key, null keys included."""
    won = state.select(F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)), *(F.col(f"`{c}`") for c in state.columns if c not in key)).alias("won"))
    match = F.lit(True)
    for i, k in enumerate(key):
        match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"won.k{i}"))
    return changes.join(won, match)


def _lost(won: Column, value: Column, version: Column, cl: Column) -> Column:
    """Whether a change isn't what won in its cell; won is null where nothing did."""
    return F.coalesce(~(won["col_value"].eqNullSafe(value) & won["col_version"].eqNullSafe(version) & won["cl"].eqNullSafe(cl)), F.lit(True)) | won.isNull()


def _losing(changes: DataFrame, state: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    best = F.when(F.col("col_name") == TOMBSTONE, F.col("won.sentinel"))
    for c in columns:
        best = best.when(F.col("col_name") == c, F.col(f"won.`{c}`"))
    return _beside(changes, state, key).where(_lost(best, F.col("col_value"), F.col("col_version"), F.col("cl")))


def rejected_rows(changes: DataFrame, key: list[str], columns: dict) -> DataFrame:
    """rejected() of row changes: the changes of their columns that lose."""
    both = _beside(_with_local(changes), merged_rows(changes, key, columns), key)
    stamp = [c for c in CHANGE if c not in ("col_name", "col_value")]
    made = []
    for c, kind in columns.items():
        value = V.to_value(F.col(f"`{c}`"), kind)
        made.append(F.when(_lost(F.col(f"won.`{c}`"), value, F.col("col_version"), F.col("cl")), F.struct(F.lit(c).alias("col_name"), value.alias("col_value"))))
    return both.select(*key, *stamp, F.explode(F.array_compact(F.array(*made))).alias("x")).select(*key, "x.*", *stamp).select(*key, *CHANGE)


def deleted(state: DataFrame, key: list[str]) -> DataFrame:
    """Keys of deleted rows with their causal length."""
    return state.where("cl % 2 = 0").select(*key, "cl")
