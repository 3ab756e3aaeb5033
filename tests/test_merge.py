"""The closed form of the merge against a sequential model, on random histories, in any order and with repeats."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmerge.functions import values as V
from driftmerge.functions.clock import TOMBSTONE
from driftmerge.operators import merge

COLUMNS = ["a", "b"]
SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("col_name", T.StringType()), T.StructField("col_value", V.VALUE), *(T.StructField(c, T.LongType()) for c in ("col_version", "db_version", "site_id", "cl", "seq"))])


def history(rng: random.Random) -> list[tuple]:
    """Changes of a few keys; all columns come with every causal length at which the row is alive."""
    out, n = [], 0
    for key in "xyz"[: rng.randint(1, 3)]:
        top = rng.randint(1, 4)
        for cl in range(1, top + 1):
            if cl % 2 == 0 or cl > 1:
                out.append((key, TOMBSTONE, (1, None, None, None, None), cl, n, rng.randint(0, 2), cl, n))
            for c in COLUMNS if cl % 2 else ():
                for version in range(1, rng.randint(2, 4)):
                    value = rng.choice([(5, rng.randint(0, 3), None, None, None), (4, None, rng.random(), None, None), (3, None, None, rng.choice("pq"), None), (1, None, None, None, None)])
                    n += 1
                    out.append((key, c, value, version, n, rng.randint(0, 2), cl, n))
    return out


def sequential(changes: list[tuple]) -> dict:
    """One change after another: causal length, then version, then value; equal changes lose."""
    rows: dict = {}
    low = lambda v: tuple((x is not None, x) if x is not None else (False, 0) for x in v)
    for key, col, value, version, _, _, cl, _ in changes:
        row = rows.setdefault(key, {"cl": 0, "cells": {}})
        if cl < row["cl"]:
            continue
        if cl > row["cl"]:
            row.update(cl=cl, cells={})
        if col != TOMBSTONE and cl % 2:
            old = row["cells"].get(col)
            if old is None or (version, low(value)) > (old[0], low(old[1])):
                row["cells"][col] = (version, value)
    return {k: (r["cl"], r["cells"]) for k, r in rows.items()}


def closed(spark, changes: list[tuple]) -> dict:
    state = merge.merged(spark.createDataFrame(changes, SCHEMA), ["k"], COLUMNS).collect()
    return {r.k: (r.cl, {c: (r[c].col_version, tuple(r[c].col_value)) for c in COLUMNS if r[c] is not None}) for r in state}


def test_closed_form_equals_sequential_merge(spark):
    rng = random.Random(5)
    for run in range(6):
        joined, expected = [], {}
        for part in range(8):  # independent histories under keys of their own
            changes = [(f"{run}-{part}-{c[0]}", *c[1:]) for c in history(rng)]
            shuffled = changes + rng.choices(changes, k=3)
            rng.shuffle(shuffled)
            expected |= sequential(shuffled)
            joined += shuffled
        assert closed(spark, joined) == expected


def test_ties_stay_local(spark):
    v = (5, 1, None, None, None)
    local = spark.createDataFrame([("x", "a", v, 1, 9, 1, 1, 0)], SCHEMA)
    incoming = spark.createDataFrame([("x", "a", v, 1, 99, 2, 1, 5)], SCHEMA)
    assert [r.db_version for r in merge.merge_changes(local, incoming, ["k"], COLUMNS, 9).collect()] == [9]
    better = incoming.withColumn("col_version", F.lit(2).cast("bigint"))
    assert [r.db_version for r in merge.merge_changes(local, better, ["k"], COLUMNS, 200).collect()] == [201]


def test_equal_versions_the_greater_value_wins(spark):
    rows = [("name1", "a", (3, None, None, s, None), 2, i, i, 1, 0) for i, s in enumerate(["note1", "note3", "note2"])]
    state = merge.merged(spark.createDataFrame(rows, SCHEMA), ["k"], ["a"])
    assert merge.rows(state, ["k"], {"a": T.StringType()}).first().a == "note3"


def test_empty_and_null_keys(spark):
    assert merge.merged(spark.createDataFrame([], SCHEMA), ["k"], COLUMNS).count() == 0
    assert merge.merged(spark.createDataFrame([(None, "a", (1, None, None, None, None), 1, 1, 1, 1, 1)], SCHEMA), ["k"], COLUMNS).count() == 1


@pytest.mark.parametrize("pair", [((5, 1, None, None, None), (4, None, 9.0, None, None)), ((4, None, 1.0, None, None), (3, None, None, "z", None)), ((3, None, None, "a", None), (2, None, None, None, b"zz")), ((2, None, None, None, b""), (1, None, None, None, None))])
def test_types_are_ranked(spark, pair):
    df = spark.createDataFrame([pair], T.StructType([T.StructField("x", V.VALUE), T.StructField("y", V.VALUE)]))
    assert df.select(V.compare(F.col("x"), F.col("y"))).first()[0] == 1


def test_row_changes_merge_as_the_changes_they_stand_for(spark):
    rng = random.Random(11)
    kinds = {"a": T.DoubleType(), "b": T.StringType()}
    stamp = ("col_version", "db_version", "site_id", "cl", "seq")
    schema = T.StructType([T.StructField("k", T.StringType()), *(T.StructField(c, t) for c, t in kinds.items()), *(T.StructField(c, T.LongType()) for c in stamp)])
    made = [(rng.choice([None, *"pqrstuv"]), rng.choice([None, 0.0, -1.5, float("nan")]), rng.choice([None, "", "x", "é"]), rng.randint(1, 2), rng.randint(1, 9), rng.randint(0, 2), rng.randint(1, 3), n) for n in range(60)]
    rows = spark.createDataFrame(made, schema)
    cells = merge.row_cells(rows, ["k"], kinds)
    assert cells.count() == 2 * len(made)
    shown = lambda df: sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    assert shown(merge.merged_rows(rows, ["k"], kinds)) == shown(merge.merged(cells, ["k"], list(kinds)))
    lost = shown(merge.rejected(cells, ["k"], list(kinds)))
    assert lost and shown(merge.rejected_rows(rows, ["k"], kinds)) == lost
    # Against the definition: a change is kept if it is what won in its cell.
    won = merge.cells(merge.merged(cells, ["k"], list(kinds)), ["k"], list(kinds)).collect()
    same = lambda r: (r.k, r.col_name, str(r.col_value), r.col_version, r.cl)
    kept = {same(r) for r in won}
    assert lost == shown(spark.createDataFrame([r for r in cells.collect() if same(r) not in kept], cells.schema))


def test_row_changes_are_sorted_by_rows_not_by_cells(spark):
    """Before the shuffle each row written is one row, so what a task sorts and may spill doesn't grow with the columns."""
    rows = spark.range(50).selectExpr("id % 7 k", "double(id) a", "string(id) b", "1L col_version", "id db_version", "0L site_id", "1L cl", "id seq")
    plan = merge.merged_rows(rows.unionByName(rows), ["k"], {"a": T.DoubleType(), "b": T.StringType()})._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
