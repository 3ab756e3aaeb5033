"""Dynamically typed values as a struct whose natural order is the order that conflicts are decided by.

VALUE is ``struct<r,i,d,s,b>``: r ranks the type (integer > float > text > blob > null) and one of the other fields holds the
value. Structs compare field by field, so ``max`` over VALUE needs no UDF and a cross-type comparison is settled by r alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = T.StructType([T.StructField("r", T.IntegerType()), T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BinaryType())])

INTEGER, FLOAT, TEXT, BLOB, NULL, NOTHING = 5, 4, 3, 2, 1, 0


def _struct(rank, i=None, d=None, s=None, b=None) -> Column:
    parts = [(rank, "int", "r"), (i, "bigint", "i"), (d, "double", "d"), (s, "string", "s"), (b, "binary", "b")]
    return F.struct(*((x if isinstance(x, Column) else F.lit(x)).cast(kind).alias(name) for x, kind, name in parts))


def null_value() -> Column:
    return _struct(NULL)


def no_value() -> Column:
    """Below all values, null included: the row isn't there."""
    return _struct(NOTHING)


def storage_class(kind: T.DataType) -> int:
    """Rank of the storage class that a Spark type is carried in."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return INTEGER
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return FLOAT
    if isinstance(kind, T.BinaryType):
        return BLOB
    return NULL if isinstance(kind, T.NullType) else TEXT


def to_value(column: Column, kind: T.DataType) -> Column:
    """column, of type kind, as a VALUE; dates, times and intervals become text, nested types their JSON text."""
    rank = storage_class(kind)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        column = F.to_json(column)
    if rank == NULL:
        return null_value()
    held = {INTEGER: "i", FLOAT: "d", TEXT: "s", BLOB: "b"}[rank]
    return F.when(column.isNull(), null_value()).otherwise(_struct(rank, **{held: column}))


def from_value(value: Column, kind: T.DataType) -> Column:
    """The value as type kind; null where it is of another storage class than kind is carried in."""
    held = {INTEGER: "i", FLOAT: "d", TEXT: "s", BLOB: "b", NULL: "s"}[storage_class(kind)]
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(value["s"], kind.simpleString())
    return value[held].cast(kind)


def is_null(value: Column) -> Column:
    return value["r"] == NULL


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1; a null struct (no such row) is below every value."""
    return F.when(left.eqNullSafe(right), 0).when(left.isNull(), -1).when(right.isNull(), 1).when(left < right, -1).otherwise(1)


def compare_blobs(left: Column, right: Column) -> Column:
    """-1, 0 or 1 by length first, then by bytes."""
    a, b = (F.struct(F.octet_length(x).alias("n"), x.alias("b")) for x in (left, right))
    return F.when(left == right, 0).when(a < b, -1).when(a > b, 1)


def shown(value: Column) -> Column:
    """The value as text, for reports: blobs as upper-case hex, null as null."""
    return F.coalesce(value["i"].cast("string"), value["d"].cast("string"), value["s"], F.hex(value["b"]))
