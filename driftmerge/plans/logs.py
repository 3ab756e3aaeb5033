"""Change logs and clocks made of ordinary tables by arithmetic, for queries and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftmerge.functions import values as V
from driftmerge.functions.clock import TOMBSTONE
from driftmerge.operators.merge import row_cells

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_COLUMNS = {"l_quantity": T.DoubleType(), "l_returnflag": T.StringType(), "l_shipdate": T.StringType()}
EVENT_KEY = ["user_id"]
EVENT_COLUMNS = {c: T.DoubleType() for c in ("click", "purchase", "signup", "view")}
ORDER_KEY = ["o_orderkey"]
ORDER_COLUMNS = {"o_orderstatus": T.StringType(), "o_totalprice": T.DoubleType(), "o_orderpriority": T.StringType()}


def lineitem_rows(lineitem: DataFrame) -> DataFrame:
    """Row changes. Keys that occur more than once act as concurrent writers; a third of the lines delete their row."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    stamp = {"col_version": 1 + part % 3, "db_version": part, "site_id": supp % 4, "cl": 1 + supp % 3, "seq": supp}
    rows = lineitem.withColumn("l_shipdate", F.to_date("l_shipdate").cast("string")).withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    return rows.select(*LINE_KEY, *LINE_COLUMNS, *(x.cast("bigint").alias(n) for n, x in stamp.items()))


def lineitem_log(lineitem: DataFrame) -> DataFrame:
    """The changes that lineitem_rows() stands for, one for each row and column."""
    return row_cells(lineitem_rows(lineitem), LINE_KEY, LINE_COLUMNS)


def events_log(events: DataFrame) -> DataFrame:
    """Errors toggle their user's row between deleted and alive; other events write the column of their type."""
    count = F.sum((F.col("event_type") == "error").cast("bigint")).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    e, error = F.col("event_id"), F.col("event_type") == "error"
    rows = events.withColumn("cl", 1 + count)
    return rows.select(
        "user_id",
        F.when(error, TOMBSTONE).otherwise(F.col("event_type")).alias("col_name"),
        F.when(error, V.null_value()).otherwise(V.to_value(F.col("value"), T.DoubleType())).alias("col_value"),
        F.when(error, F.col("cl")).otherwise(1 + F.floor(e / 4) % 5).cast("bigint").alias("col_version"),
        F.floor(e / 16).cast("bigint").alias("db_version"),
        (e % 4).cast("bigint").alias("site_id"),
        F.col("cl").cast("bigint").alias("cl"),
        (e % 16).cast("bigint").alias("seq"),
    )


def orders_before(orders: DataFrame) -> DataFrame:
    return orders.select(*ORDER_KEY, *ORDER_COLUMNS)


def orders_after(orders: DataFrame) -> DataFrame:
    """A third of the orders deleted, a fifth of the rest repriced, a seventh of all copied under new keys."""
    k = F.col("o_orderkey")
    rest = orders_before(orders).where(k % 3 != 0).withColumn("o_totalprice", F.when(k % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return rest.unionByName(orders_before(orders).where(k % 7 == 0).withColumn("o_orderkey", k + 1_000_000_000))


def first_clocks(rows: DataFrame, key: list[str], columns: list[str], db_version: int = 1) -> DataFrame:
    """What clocks the rows have after one transaction that inserted them."""
    made = rows.select(*key, F.explode(F.array(*(F.struct(F.lit(c).alias("col_name"), F.lit(i).alias("i")) for i, c in enumerate(columns)))).alias("x"))
    return made.select(*key, "x.col_name", F.lit(1).cast("bigint").alias("col_version"), F.lit(db_version).cast("bigint").alias("db_version"), F.lit(0).alias("site_id"), F.col("x.i").cast("bigint").alias("seq"))


def order_clocks(orders: DataFrame) -> DataFrame:
    """Clocks of the orders from four sites, every ninth row deleted and inserted again; every tenth order is a deleted row of another key."""
    k = F.col("o_orderkey")
    stamp = [(1 + k % 100).cast("bigint").alias("db_version"), (k % 4).cast("int").alias("site_id")]
    cells = orders.select(*ORDER_KEY, F.explode(F.array(*(F.struct(F.lit(c).alias("col_name"), F.lit(i).alias("i")) for i, c in enumerate(ORDER_COLUMNS)))).alias("x"), (1 + k % 3).cast("bigint").alias("col_version"), *stamp)
    cells = cells.select(*ORDER_KEY, "x.col_name", "col_version", "db_version", "site_id", (k * 4 + F.col("x.i") + 1).cast("bigint").alias("seq"))
    born = orders.where(k % 9 == 0).select(*ORDER_KEY, F.lit(TOMBSTONE).alias("col_name"), F.lit(3).cast("bigint").alias("col_version"), *stamp, (k * 4).cast("bigint").alias("seq"))
    gone = orders.where(k % 10 == 0).select((k + 1_000_000_000).alias("o_orderkey"), F.lit(TOMBSTONE).alias("col_name"), F.lit(2).cast("bigint").alias("col_version"), *stamp, (k * 4).cast("bigint").alias("seq"))
    return cells.unionByName(born).unionByName(gone)


def visible_orders(orders: DataFrame) -> DataFrame:
    return orders_before(orders).where(F.col("o_orderkey") % 10 != 1)
