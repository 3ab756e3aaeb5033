"""Binary codec of typed values, as expressions for writing and an Arrow-batched decoder for reading.

A value is a type byte ``tag | width << 3`` and its bytes, big-endian. Integers take the least width k that leaves a sign bit
free (8 k - 1 bits of magnitude). Text and blobs are preceded by their length, written like an integer. A key starts with a
count byte; a row of a payload does not.
"""

from __future__ import annotations

import struct

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmerge.functions import values as V

# Fixed values of the format.
TAG_NEGATIVE_INT, TAG_INT, TAG_FLOAT, TAG_TEXT, TAG_BLOB, TAG_NULL, TAG_INT_MIN, TAG_NEGATIVE_FLOAT = range(8)
INT64_MIN = -(1 << 63)
MAX_KEY_VALUES = 255
_DOUBLE = struct.Struct(">d")


class CodecError(ValueError):
    """Bytes that are no encoding."""


def _width(magnitude: Column) -> Column:
    bits = F.length(F.bin(magnitude))
    return F.floor(bits / 8).cast("int") + 1


def _sized(tag: int, magnitude: Column) -> Column:
    """Hex of the type byte and the magnitude in its least width."""
    width = _width(magnitude)
    return F.concat(F.lpad(F.hex(width * 8 + tag), 2, "0"), F.lpad(F.hex(magnitude), width * 2, F.lit("0")))


def double_bits(d: Column) -> Column:
    """IEEE 754 bits of a double that is not negative, as a bigint, from exact powers of two."""
    guess = F.floor(F.log2(d)).cast("int")
    two = lambda n: F.pow(F.lit(2.0), n)
    exponent = guess + F.when(d / two(guess) < 1, -1).when(d / two(guess) >= 2, 1).otherwise(0)
    fraction = ((d / two(exponent) - 1) * float(1 << 52)).cast("bigint")
    normal = F.shiftleft((exponent + 1023).cast("bigint"), 52).bitwiseOR(fraction)
    tiny = (d * two(F.lit(537)) * two(F.lit(537))).cast("bigint")
    infinite = F.when(F.isnan(d), F.lit(0x7FF8 << 48)).otherwise(F.lit(0x7FF0 << 48))
    return F.when(F.isnan(d) | (d == float("inf")), infinite).when(d == 0, F.lit(0)).when(d < 2.2250738585072014e-308, tiny).otherwise(normal)


def _integer(i: Column) -> Column:
    return F.when(i == INT64_MIN, F.lit("06")).when(i < 0, _sized(TAG_NEGATIVE_INT, -i)).otherwise(_sized(TAG_INT, i))


def _float(d: Column) -> Column:
    return F.concat(F.when(d < 0, F.lit("07")).otherwise(F.lit("02")), F.lpad(F.hex(double_bits(F.abs(d))), 16, "0"))


def _text(s: Column) -> Column:
    return F.concat(_sized(TAG_TEXT, F.octet_length(s).cast("bigint")), F.hex(F.encode(s, "UTF-8")))


def _blob(b: Column) -> Column:
    return F.concat(_sized(TAG_BLOB, F.octet_length(b).cast("bigint")), F.hex(b))


def encoded(value: Column) -> Column:
    """Hex of one VALUE's encoding."""
    r = value["r"]
    return F.when(r == V.INTEGER, _integer(value["i"])).when(r == V.FLOAT, _float(value["d"])).when(r == V.TEXT, _text(value["s"])).when(r == V.BLOB, _blob(value["b"])).otherwise(F.lit("05"))


def encoded_as(column: Column, kind: T.DataType) -> Column:
    """Hex of a column's encoding, the same as of its VALUE; only its own storage class is in the expression, so it compiles to little code."""
    held = {V.INTEGER: lambda c: _integer(c.cast("bigint")), V.FLOAT: lambda c: _float(c.cast("double")), V.TEXT: lambda c: _text(c.cast("string")), V.BLOB: _blob}
    rank = V.storage_class(kind)
    if rank == V.NULL or isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return encoded(V.to_value(column, kind))
    return F.when(column.isNull(), F.lit("05")).otherwise(held[rank](column))


def encode_key(key: list[Column]) -> Column:
    """Binary of the key that some VALUEs make up."""
    if not 1 <= len(key) <= MAX_KEY_VALUES:
        raise CodecError(f"a key has 1 to {MAX_KEY_VALUES} values, not {len(key)}")
    return F.unhex(F.concat(F.lit(f"{len(key):02X}"), *(encoded(v) for v in key)))


def _sized_bytes(tag: int, n: int) -> bytes:
    width = n.bit_length() // 8 + 1
    return bytes((tag | width << 3,)) + n.to_bytes(width, "big")


def integer_bytes(i: int) -> bytes:
    if i == INT64_MIN:
        return bytes((TAG_INT_MIN,))
    return _sized_bytes(TAG_NEGATIVE_INT, -i) if i < 0 else _sized_bytes(TAG_INT, i)


def float_bytes(d: float) -> bytes:
    return bytes((TAG_NEGATIVE_FLOAT if d < 0 else TAG_FLOAT,)) + _DOUBLE.pack(abs(d))


def text_bytes(s: str) -> bytes:
    raw = s.encode()
    return _sized_bytes(TAG_TEXT, len(raw)) + raw


def blob_bytes(b: bytes) -> bytes:
    return _sized_bytes(TAG_BLOB, len(b)) + b


_OF_CLASS = {"i": integer_bytes, "d": float_bytes, "s": text_bytes, "b": blob_bytes}
NULL_BYTES = bytes((TAG_NULL,))


def encoded_column(column: pa.Array) -> list[bytes]:
    """The encoding of each of a column's values, or VALUEs; each distinct value is encoded once."""
    if pa.types.is_struct(column.type):
        ranks = column.field("r").to_pylist()
        parts = {r: encoded_column(column.field(k)) for r, k in ((V.INTEGER, "i"), (V.FLOAT, "d"), (V.TEXT, "s"), (V.BLOB, "b")) if r in ranks}
        return [parts[r][n] if r in parts else NULL_BYTES for n, r in enumerate(ranks)]
    kind = "i" if pa.types.is_integer(column.type) else "d" if pa.types.is_floating(column.type) else "b" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "s"
    if kind == "d":  # 0.0 and -0.0 are equal, but not as bytes
        return [NULL_BYTES if d is None else float_bytes(d) for d in column.to_pylist()]
    values, of = column.to_pylist(), _OF_CLASS[kind]
    made = {v: of(v) for v in set(values) if v is not None} | {None: NULL_BYTES}
    return [made[v] for v in values]


class Decoded:
    """Decoded values one after another, as the columns of VALUE."""

    __slots__ = ("r", "i", "d", "s", "b")
    KINDS = {"r": pa.int32(), "i": pa.int64(), "d": pa.float64(), "s": pa.string(), "b": pa.binary()}

    def __init__(self) -> None:
        self.r, self.i, self.d, self.s, self.b = [], [], [], [], []

    def __len__(self) -> int:
        return len(self.r)

    def cut(self, n: int) -> None:
        """Forget all but the first n."""
        for x in (self.r, self.i, self.d, self.s, self.b):
            del x[n:]

    def put(self, r: int, i=None, d=None, s=None, b=None) -> None:
        self.r.append(r)
        self.i.append(i)
        self.d.append(d)
        self.s.append(s)
        self.b.append(b)

    def every(self, n: int = 1, first: int = 0) -> pa.StructArray:
        """Each n-th value from the first-th on."""
        return pa.StructArray.from_arrays([pa.array(getattr(self, k)[first::n], kind) for k, kind in self.KINDS.items()], list(self.KINDS))


def decode(data: bytes, at: int, count: int, out: Decoded) -> int:
    """Put count values from ``at`` on into out; where they end. Of an encoding that breaks off nothing is left in out."""
    held, end = len(out), len(data)
    for _ in range(count):
        head = data[at] if at < end else TAG_NULL | 0xF8
        tag, width = head & 7, head >> 3
        at += 1
        if tag in (TAG_INT, TAG_NEGATIVE_INT, TAG_TEXT, TAG_BLOB):
            number = int.from_bytes(data[at : at + width], "big")
            at += width
            if tag == TAG_TEXT:
                out.put(V.TEXT, s=data[at : at + number].decode(errors="replace"))
                at += number
            elif tag == TAG_BLOB:
                out.put(V.BLOB, b=data[at : at + number])
                at += number
            elif number - (tag == TAG_NEGATIVE_INT) >= 1 << 63:
                at = end + 1
            else:
                out.put(V.INTEGER, -number if tag == TAG_NEGATIVE_INT else number)
        elif tag in (TAG_FLOAT, TAG_NEGATIVE_FLOAT):
            if at + 8 <= end:
                number = _DOUBLE.unpack_from(data, at)[0]
                out.put(V.FLOAT, d=-number if tag == TAG_NEGATIVE_FLOAT else number)
            at += 8
        elif tag == TAG_INT_MIN:
            out.put(V.INTEGER, INT64_MIN)
        else:
            out.put(V.NULL)
        if at > end:
            out.cut(held)
            raise CodecError("the encoding ends too early")
    return at


class DecodedRows:
    """Rows of a fixed number of values, column by column: in one list each, by the kind that the column holds.

    A value of another kind than its column's counts as null. A kind of '' holds values of any kind, as the columns of VALUE.
    """

    __slots__ = ("kinds", "lists", "any", "steps")
    _OF = {"i": (TAG_INT, TAG_NEGATIVE_INT, TAG_INT_MIN), "d": (TAG_FLOAT, TAG_NEGATIVE_FLOAT), "s": (TAG_TEXT,), "b": (TAG_BLOB,)}

    def __init__(self, kinds: tuple[str, ...]) -> None:
        self.kinds, self.any = kinds, Decoded()
        self.lists: list[list] = [[] for _ in kinds]
        self.steps = [(None if k == "" else x.append, *(t in self._OF.get(k, ()) for t in (TAG_INT, TAG_FLOAT, TAG_TEXT, TAG_BLOB))) for k, x in zip(kinds, self.lists, strict=True)]

    def __len__(self) -> int:
        return len(self.any) if "" in self.kinds else len(self.lists[0])

    def arrays(self) -> list[pa.Array]:
        return [pa.array(x, Decoded.KINDS[k]) if k else self.any.every() for k, x in zip(self.kinds, self.lists, strict=True)]

    def row(self, data: bytes, at: int) -> int:
        """Add the row at ``at``; where it ends. Of one that breaks off nothing is added."""
        end, held = len(data), len(self)
        try:
            for put, is_int, is_float, is_text, is_blob in self.steps:
                if put is None:
                    at = decode(data, at, 1, self.any)
                    continue
                head = data[at]
                tag = head & 7
                at += 1
                if tag == TAG_TEXT or tag == TAG_BLOB:
                    width = head >> 3
                    begin = at + width
                    at = begin + int.from_bytes(data[at:begin], "big")
                    if begin > end or at > end:
                        raise IndexError
                    put((data[begin:at].decode(errors="replace") if is_text else None) if tag == TAG_TEXT else data[begin:at] if is_blob else None)
                elif tag == TAG_INT or tag == TAG_NEGATIVE_INT:
                    begin, at = at, at + (head >> 3)
                    number = int.from_bytes(data[begin:at], "big")
                    if at > end or number - (tag == TAG_NEGATIVE_INT) >= 1 << 63:
                        raise IndexError
                    put((-number if tag == TAG_NEGATIVE_INT else number) if is_int else None)
                elif tag == TAG_FLOAT or tag == TAG_NEGATIVE_FLOAT:
                    begin, at = at, at + 8
                    if at > end:
                        raise IndexError
                    number = _DOUBLE.unpack_from(data, begin)[0]
                    put((-number if tag == TAG_NEGATIVE_FLOAT else number) if is_float else None)
                else:
                    put(INT64_MIN if tag == TAG_INT_MIN and is_int else None)
        except (IndexError, CodecError) as e:
            self.any.cut(held)
            for x in self.lists:
                del x[held:]
            raise CodecError("the encoding ends too early") from e
        return at


def decode_key(key: bytes, out: Decoded) -> int:
    """Put the values of a key into out; how many they are."""
    if not key:
        raise CodecError("an empty key")
    held = len(out)
    if decode(key, 1, key[0], out) != len(key):
        out.cut(held)
        raise CodecError("bytes after the key's last value")
    return key[0]


def keys_decoded(keys: list[bytes | None]) -> pa.ListArray:
    out, ends, right = Decoded(), [0], []
    for key in keys:
        try:
            right.append(key is not None and decode_key(key, out) > 0)
        except CodecError:
            right.append(False)
        ends.append(len(out))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), out.every(), mask=pa.array([not x for x in right], pa.bool_()))


@F.arrow_udf(T.ArrayType(VALUE := V.VALUE))
def decoded_key(keys: pa.Array) -> pa.Array:
    """array<VALUE> of each key; null for null, and for bytes that are no key. A batch's distinct keys are decoded once each."""
    distinct = pc.dictionary_encode(keys, null_encoding="encode")
    return keys_decoded(distinct.dictionary.to_pylist()).take(distinct.indices)


def key_of(columns: list[tuple[Column, T.DataType]]) -> Column:
    """Binary of the key that some columns make up; the same as encode_key() of their VALUEs."""
    if not 1 <= len(columns) <= MAX_KEY_VALUES:
        raise CodecError(f"a key has 1 to {MAX_KEY_VALUES} values, not {len(columns)}")
    return F.unhex(F.concat(F.lit(f"{len(columns):02X}"), *(encoded_as(c, kind) for c, kind in columns)))


def key_value(key: Column, n: int) -> Column:
    """The n-th value of a key, from 1; null beyond its last."""
    return F.get(decoded_key(key), n - 1)


def integer_key(key: Column) -> Column:
    """The value of a key that is one integer; null for any other key, for null and for bytes that are no key. No Python is run for it."""
    digits = F.hex(key)
    head = F.conv(F.substring(digits, 3, 2), 16, 10).cast("int")
    tag, rest = head.bitwiseAND(7), F.substring(digits, 5, 1 << 20)
    short = F.ltrim(rest, F.lit("0"))
    number = F.when(short == "", F.lit("0")).when(F.length(short) <= 16, F.conv(short, 16, 10))
    whole = F.length(rest) == F.shiftright(head, 3) * 2
    value = F.when((tag == TAG_INT) & whole, number.try_cast("bigint")).when((tag == TAG_NEGATIVE_INT) & whole, F.concat(F.lit("-"), number).try_cast("bigint")).when((tag == TAG_INT_MIN) & (rest == ""), F.lit(INT64_MIN))
    return F.when(F.startswith(digits, F.lit("01")) & (F.length(digits) >= 4), value)
