"""Payloads: changes in a compact binary form with a header, made and read by partitions.

A partition's rows are encoded column by column of an Arrow batch, joined and compressed; payloads are decoded into columns again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmerge.functions import codec
from driftmerge.functions import values as V
from driftmerge.functions.clock import VERSION, version_number
from driftmerge.plans.schema import SchemaMismatch

# Fixed values of the header: signature, protocol version; big-endian, 32 bytes.
HEADER = struct.Struct(">IB3BIHIQ6x")
SIGNATURE = 0x434C5359
PROTOCOL = 1
HEADER_FIELDS = ("signature", "protocol", "major", "minor", "patch", "expanded_size", "ncols", "nrows", "schema_hash")

CHANGES = T.StructType([T.StructField("tbl", T.StringType()), T.StructField("pk", T.BinaryType()), T.StructField("col_name", T.StringType()), T.StructField("col_value", V.VALUE), T.StructField("col_version", T.LongType()), T.StructField("db_version", T.LongType()), T.StructField("site_id", T.BinaryType()), T.StructField("cl", T.LongType()), T.StructField("seq", T.LongType())])
PAYLOADS = "payload binary, n_rows long, db_version long, seq long"

ROWS = 100_000
BYTES = 64 << 20


class PayloadError(ValueError):
    """Bytes that are no payload."""


def _packed(body: bytes, n_rows: int, n_cols: int, schema_hash: int, compress: bool) -> bytes:
    small = pa.Codec("lz4_raw").compress(body, asbytes=True) if compress and body else body
    raw = not compress or len(small) > len(body)
    head = HEADER.pack(SIGNATURE, PROTOCOL, *version_number(VERSION), 0 if raw else len(body), n_cols, n_rows, schema_hash)
    return head + (body if raw else small)


def header(payload: bytes) -> dict[str, int]:
    if len(payload) < HEADER.size:
        raise PayloadError("a payload has a header of 32 bytes")
    found = dict(zip(HEADER_FIELDS, HEADER.unpack(payload[: HEADER.size]), strict=True))
    if found["signature"] != SIGNATURE or not found["ncols"]:
        raise PayloadError("no payload: signature or number of columns")
    return found


def encode(changes: DataFrame, schema_hash: int = 0, compress: bool = True, rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """Payloads of changes (columns of CHANGES) in the order of (db_version, seq), each with its number of rows and last cursor.

    Changes are dealt by ranges of that order, so payloads are made in parallel and are in order across partitions too. A payload
    ends at ``rows`` rows or ``most_bytes`` bytes, whichever comes first. No changes, no payloads.
    """
    kinds = {f.name: f.dataType for f in CHANGES}
    n = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = changes.select(*(F.col(c).cast(kinds[c]) if c != "col_value" else F.col(c) for c in CHANGES.names)).repartitionByRange(n, "db_version", "seq").sortWithinPartitions("db_version", "seq")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, last = 0, (0, 0)

        def out() -> pa.RecordBatch:
            made = _packed(b"".join(held), len(held), len(CHANGES), schema_hash, compress)
            return pa.RecordBatch.from_pylist([{"payload": made, "n_rows": len(held), "db_version": last[0], "seq": last[1]}], pa.schema([("payload", pa.binary()), ("n_rows", pa.int64()), ("db_version", pa.int64()), ("seq", pa.int64())]))

        for batch in batches:
            encoded = map(b"".join, zip(*(codec.encoded_column(c) for c in batch.columns), strict=True))
            for row, version, seq in zip(encoded, batch.column("db_version").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                if held and (len(held) >= rows or size + len(row) > most_bytes):
                    yield out()
                    held.clear()
                    size = 0
                held.append(row)
                size += len(row)
                last = (version, seq)
        if held:
            yield out()

    return dealt.mapInArrow(pack, PAYLOADS)


def _body(payload: bytes, accepted: frozenset[int] | None) -> tuple[dict[str, int], bytes]:
    """A payload's header and its rows' bytes."""
    head = header(payload)
    if accepted is not None and head["schema_hash"] not in accepted:
        raise SchemaMismatch(f"the schema hash {head['schema_hash']} is unknown here")
    body = payload[HEADER.size :]
    if head["expanded_size"]:
        try:
            body = pa.Codec("lz4_raw").decompress(body, decompressed_size=head["expanded_size"], asbytes=True)
        except (OSError, pa.ArrowException) as e:
            raise PayloadError("the payload can't be decompressed") from e
        if len(body) != head["expanded_size"]:
            raise PayloadError("the payload is shorter than stated")
    return head, body


_HELD = {"tbl": "s", "pk": "b", "col_name": "s", "col_value": "", "col_version": "i", "db_version": "i", "site_id": "b", "cl": "i", "seq": "i"}
_ARROW = pa.schema([(c, codec.Decoded.KINDS[k] if k else pa.struct(list(codec.Decoded.KINDS.items()))) for c, k in _HELD.items()])
#: Rows that are decoded at a time.
_SOME = 10_000


def decode(payloads: DataFrame, column: str = "payload", accepted: Iterable[int] | None = None, skip: bool = False) -> DataFrame:
    """Changes of the payloads; with ``accepted``, a payload under another schema hash raises SchemaMismatch in the job.

    Bytes that are no payload, or break off in a row, raise an error in the job. With ``skip`` they don't: a column ``error`` is
    added, null for changes, and each such payload makes one row more that has nothing but its error. Rows before the break count.
    """
    hashes = None if accepted is None else frozenset(accepted)
    schema = pa.schema([*_ARROW, ("error", pa.string())]) if skip else _ARROW

    def made(values: codec.DecodedRows) -> pa.RecordBatch:
        columns = values.arrays()
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.string())] if skip else columns, schema=schema)

    def rows(payload: bytes) -> Iterator[codec.DecodedRows]:
        head, body = _body(payload, hashes)
        if head["ncols"] != len(_HELD):
            raise PayloadError(f"rows of {head['ncols']} values")
        at, values = 0, codec.DecodedRows(tuple(_HELD.values()))
        try:
            for n in range(head["nrows"]):
                at = values.row(body, at)
                if (n + 1) % _SOME == 0:
                    yield values
                    values = codec.DecodedRows(tuple(_HELD.values()))
        finally:
            if len(values):
                yield values

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                try:
                    for values in rows(payload) if payload is not None else ():
                        yield made(values)
                except (PayloadError, codec.CodecError) as e:
                    if not skip:
                        raise
                    yield pa.RecordBatch.from_pylist([{"error": str(e)}], schema)

    return payloads.select(column).mapInArrow(split, T.StructType([*CHANGES, T.StructField("error", T.StringType())]) if skip else CHANGES)
