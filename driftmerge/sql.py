"""The change feed and the functions on changes by name, for ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from driftmerge.functions import codec
from driftmerge.functions.clock import SEQ_BITS, VERSION

_ROW_ID = f"case when seq between 0 and {(1 << SEQ_BITS) - 1} then shiftleft(version, {SEQ_BITS}) | seq end"


def install(changes: DataFrame, site_id: bytes, prefix: str = "drift") -> None:
    """Temporary names of the session, each after ``prefix_``; installing again replaces them.

    changes (a view of the feed), changes_since(version, seq) and changes_of(tbl) as table functions, db_version(), site_id(),
    version(), row_id(version, seq), row_id_version(id), row_id_seq(id), uuid_text(hex), uuid_compare(a, b), pk_values(pk) and
    pk_value(pk, n). Catalyst puts the functions' bodies into the query, so filters on the view and on its functions reach the scans.
    """
    spark = changes.sparkSession
    changes.createOrReplaceTempView(f"{prefix}_changes")
    spark.udf.register(f"{prefix}_pk_values", codec.decoded_key)
    bodies = {
        "version() returns string": f"'{VERSION}'",
        "site_id() returns binary": f"X'{site_id.hex()}'",
        "db_version() returns bigint": f"(select coalesce(max(db_version), 0) from {prefix}_changes)",
        "row_id(version bigint, seq bigint) returns bigint": _ROW_ID,
        "row_id_version(id bigint) returns bigint": f"shiftrightunsigned(id, {SEQ_BITS})",
        "row_id_seq(id bigint) returns bigint": f"id & {(1 << SEQ_BITS) - 1}",
        "uuid_text(plain string) returns string": "regexp_replace(lower(plain), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')",
        "uuid_compare(a binary, b binary) returns int": "case when a = b then 0 when a < b then -1 when a > b then 1 end",
        "changes_since(version bigint, last bigint) returns table": f"select * from {prefix}_changes where db_version > version or (db_version = version and seq > last)",
        "changes_of(name string) returns table": f"select * from {prefix}_changes where lower(tbl) = lower(name)",
    }
    for head, body in bodies.items():
        spark.sql(f"create or replace temporary function {prefix}_{head} return {body}")
