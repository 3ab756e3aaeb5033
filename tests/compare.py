"""Rows of a Spark query beside those of DuckDB SQL on the same files."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as from '{source}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    return bytes(x) if isinstance(x, bytearray) else x


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, sf_dir: str = SF) -> int:
    """That df has the rows that sql gives; how many."""
    found = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
    extra, missing = ours - theirs, theirs - ours
    assert not extra and not missing, f"{sum(ours.values())} and {sum(theirs.values())} rows; only in Spark {list(extra)[:3]}, only in SQL {list(missing)[:3]}"
    return sum(ours.values())
