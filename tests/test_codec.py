import math
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmerge.functions import clock, codec
from driftmerge.functions import values as V
from driftmerge.operators.feed import glob
from driftmerge.sources import payload
from driftmerge.sources.transport import endpoints

INTS = [0, 1, -1, 127, 128, -128, 32767, 32768, 2**31 - 1, 2**31, 2**39 - 1, 2**47, 2**55, 2**63 - 1, -(2**63), -15592946911031981, -922337203685477580]
FLOATS = [0.0, 1.0, -1.5, -9223372036854775.808, 1e308, 5e-324, 2.2250738585072014e-308, 1e-310, 0.1, 3.0000000000000004, math.inf, -math.inf, 2.0**1023, 1 - 2**-53]
TEXTS = ["", "Hello World", "ü" * 200, "nul\0inside", "x" * 40_000]
BLOBS = [b"", bytes(range(17)), b"\0" * 300]


def expected(v) -> bytes:
    """A plain encoder of one value."""

    def sized(tag: int, n: int) -> bytes:
        width = n.bit_length() // 8 + 1
        return bytes([tag | width << 3]) + n.to_bytes(width, "big")

    if v is None:
        return b"\x05"
    if isinstance(v, int):
        return b"\x06" if v == -(2**63) else sized(0 if v < 0 else 1, abs(v))
    if isinstance(v, float):
        return (b"\x07" if v < 0 else b"\x02") + struct.pack(">d", abs(v))
    raw = v.encode() if isinstance(v, str) else v
    return sized(3 if isinstance(v, str) else 4, len(raw)) + raw


def as_value(v):
    if v is None:
        return (1, None, None, None, None)
    rank, at = {int: (5, 0), float: (4, 1), str: (3, 2), bytes: (2, 3)}[type(v)]
    return (rank, *(v if i == at else None for i in range(4)))


def test_values_are_encoded_and_decoded(spark):
    rng = random.Random(3)
    many = INTS + FLOATS + TEXTS + BLOBS + [None] + [rng.randint(-(2**62), 2**62) >> rng.randint(0, 60) for _ in range(300)] + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(300)]
    df = spark.createDataFrame([(i, as_value(v)) for i, v in enumerate(many)], T.StructType([T.StructField("n", T.IntegerType()), T.StructField("v", V.VALUE)]))
    key = codec.encode_key([F.col("v"), V.null_value()])
    for r in df.select("n", key.alias("key"), codec.decoded_key(key).alias("back")).collect():
        assert bytes(r.key) == b"\x02" + expected(many[r.n]) + b"\x05", many[r.n]
        assert [tuple(x) for x in r.back] == [as_value(many[r.n]), as_value(None)]
    for kind, spark_kind, values in ((pa.int64(), T.LongType(), INTS), (pa.float64(), T.DoubleType(), [*FLOATS, -0.0]), (pa.string(), T.StringType(), TEXTS), (pa.binary(), T.BinaryType(), BLOBS)):
        assert codec.encoded_column(pa.array([*values, None, values[0]], kind)) == [expected(v) for v in [*values, None, values[0]]]
        table = spark.createDataFrame([(v,) for v in [*values, None]], T.StructType([T.StructField("v", spark_kind)]))
        same = table.select(codec.key_of([(F.col("v"), spark_kind)]).alias("a"), codec.encode_key([V.to_value(F.col("v"), spark_kind)]).alias("b")).collect()
        assert all(r.a == r.b for r in same) and len(same) == len(values) + 1


def test_broken_keys_are_refused(spark):
    for key in (b"", b"\x01", b"\x01\x13abc", b"\x01\x05\x05", b"\x02\x05"):
        with pytest.raises(codec.CodecError):
            codec.decode_key(key, codec.Decoded())
    table = spark.createDataFrame([(b"\x01\x13abc",), (None,), (b"\x01\x0b\x01a",)], "k binary")
    assert [r.v and r.v[0].s for r in table.select(codec.decoded_key(F.col("k")).alias("v")).collect()] == [None, None, "a"]


def test_row_ids(spark):
    pairs = [(14963874252 >> 4, 172784902), (0, 0), (2**34 - 1, 2**30 - 1), (1, 5)]
    df = spark.createDataFrame(pairs, "v bigint, s bigint").withColumn("id", clock.row_id(F.col("v"), F.col("s")))
    assert {tuple(r) for r in df.select(clock.row_id_version(F.col("id")), clock.row_id_seq(F.col("id"))).collect()} == set(pairs)


def test_uuid7():
    ids = [clock.uuid7() for _ in range(1000)]
    assert len(set(ids)) == 1000 and all(x[6] >> 4 == 7 and x[8] >> 6 == 2 and len(x) == 16 for x in ids)


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = clock.numbered(df, ["x"], "n", 5).orderBy("n").collect()
    assert [(r.x, r.n) for r in got] == [(i, i + 5) for i in range(1000)]
    assert clock.numbered(df.where("x < 0"), ["x"]).count() == 0


def test_glob(spark):
    df = spark.createDataFrame([("abc.txt",), ("a]c",), ("Abc.txt",), ("a\nb",)], "s string")
    keep = lambda p: [r.s for r in df.where(glob(F.col("s"), p)).collect()]
    assert keep("a*") == ["abc.txt", "a]c", "a\nb"] and keep("[A-B]*.txt") == ["Abc.txt"] and keep("a[]]c") == ["a]c"] and keep("a?b") == ["a\nb"] and keep("abc.tx") == []


def test_payload_checks(spark):
    with pytest.raises(payload.PayloadError):
        payload.header(b"short")
    with pytest.raises(payload.PayloadError):
        payload.header(bytes(32))
    body = b"".join(expected(v) for v in ("t", b"k", "c", 5, 1, 1, b"s", 1, 0))
    table = lambda *made: spark.createDataFrame([(m,) for m in made], "payload binary")
    for compress in (True, False):
        made = payload._packed(body * 50, 50, 9, 4, compress)
        rows = payload.decode(table(made, None), accepted=[4]).collect()
        assert len(rows) == 50 and (len(made) < 32 + len(body) * 50) == compress
        assert (rows[0].tbl, bytes(rows[0].pk), rows[0].col_name, rows[0].col_value.i, bytes(rows[0].site_id), rows[0].seq) == ("t", b"k", "c", 5, b"s", 0)
        with pytest.raises(Exception, match="schema hash"):
            payload.decode(table(made), accepted=[5]).collect()
    broken = payload._packed(body, 2, 9, 4, False)
    with pytest.raises(Exception, match="ends too early"):
        payload.decode(table(broken)).collect()
    found = payload.decode(table(broken, b"short", payload._packed(body, 1, 9, 4, True)), skip=True).collect()
    assert sum(r.error is None for r in found) == 2 and sorted(r.error for r in found if r.error) == ["a payload has a header of 32 bytes", "the encoding ends too early"]
    assert payload.encode(spark.createDataFrame([], payload.CHANGES)).count() == 0


def test_endpoints():
    at = endpoints("cloud://host.example:8860/db.sqlite?x=1&token=t", bytes(16), aliases=("cloud",))
    assert at.check == f"https://host.example:443/v1/changes/db.sqlite/{'0' * 32}" and at.upload == at.check + "/upload" and at.authentication == "token=t"
    assert at.with_apikey("k").authentication == "apikey=k" and at.with_token("u").check == at.check
    with pytest.raises(ValueError):
        endpoints("https://host.example", bytes(16))


def test_integer_keys_are_decoded_without_python_as_with_it(spark):
    ints = [0, 1, -1, 127, 128, -128, -255, 1 << 40, (1 << 63) - 1, -(1 << 63), 1 - (1 << 63)]
    keys = [b"\x01" + codec.integer_bytes(i) for i in ints]
    keys += [b"\x01" + bytes((codec.TAG_NEGATIVE_INT | 8 << 3,)) + (1 << 63).to_bytes(8, "big"), b"\x01" + bytes((codec.TAG_INT | 12 << 3,)) + (77).to_bytes(12, "big"), b"\x01\x01"]
    keys += [None, b"", b"\x01", b"\x02" + keys[0][1:], keys[3] + b"\0", keys[7][:-1], b"\x01" + codec.text_bytes("a"), b"\x01" + codec.float_bytes(1.0), b"\x01\x05", b"\x01" + bytes((codec.TAG_INT | 8 << 3,)) + b"\xff" * 8, b"\x01" + bytes((codec.TAG_INT | 9 << 3,)) + b"\x01" + b"\0" * 8, b"\x01\x06\x00"]
    table = spark.createDataFrame([(n, None if k is None else bytearray(k)) for n, k in enumerate(keys)], "n int, k binary")
    back = table.select("n", codec.integer_key(F.col("k")).alias("i"), codec.decoded_key(F.col("k")).alias("v")).collect()
    assert [r.i for r in sorted(back, key=lambda r: r.n)][: len(ints)] == ints
    for r in back:
        assert r.i == (r.v[0].i if r.v and len(r.v) == 1 else None), keys[r.n]


def test_rows_are_decoded_column_by_column_as_one_by_one():
    rng = random.Random(3)
    some = (lambda: codec.integer_bytes(rng.choice([0, -1, 1 << 40, codec.INT64_MIN, (1 << 63) - 1])), lambda: codec.float_bytes(rng.choice([0.0, -2.5])), lambda: codec.text_bytes(rng.choice(["", "aé", "x" * 300])), lambda: codec.blob_bytes(rng.choice([b"", b"\xff"])), lambda: codec.NULL_BYTES)
    kinds = ("s", "b", "", "i", "d")
    for n in range(600):
        body = b"".join(rng.choice(some)() for _ in range(10))
        body = body[: rng.randint(0, len(body))] if n % 2 else body
        body = bytes(rng.randrange(256) if rng.random() < 0.05 else x for x in body) if n % 4 == 3 else body
        one, many, ends = codec.Decoded(), codec.DecodedRows(kinds), []
        for step in (lambda at: codec.decode(body, at, 5, one), lambda at: many.row(body, at)):
            at = 0
            try:
                for _ in range(2):
                    at = step(at)
                ends.append(at)
            except codec.CodecError as e:
                ends.append(str(e))
        assert ends[0] == ends[1]
        want = [list(getattr(one, k)[j::5]) if k else one.every(5, j).to_pylist() for j, k in enumerate(kinds)]
        assert str([x.to_pylist() for x in many.arrays()]) == str(want)
