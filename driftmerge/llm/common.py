"""Helpers that the text operators share: Arrow text buffers, rolling hashes, word hashes, joins with hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.functions.staging import drop_staged, stage  # noqa: F401

CHUNK_BYTES = 1 << 20
#: Of texts that become many arrays of 8 bytes a byte: so few at a time that a Python process stays small.
SMALL_CHUNK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Keys that are joined by broadcast, at most: those that have 1 / HOT of all rows or more.
HOT = 1000


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the facts of their keys (inner join). facts has one row for each key, and in ``n`` how many rows have the key.

    Keys with many rows would each make one task's work, so their facts go to all rows instead: no more than HOT rows of facts,
    however large the tables. facts should be a written table, as it is read several times.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT >= total
    often, rest = F.broadcast(facts.where(hot)), facts.where(~hot)
    few = rows.join(F.broadcast(facts.where(hot).select(keys)), keys, "left_anti")
    return rows.join(often, keys).unionByName(few.join(rest, keys))


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """_row: every column but the text; _text; so that no column of the caller can clash with ours."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select((F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none"))).alias("_row"), F.col(f"`{text_col}`").alias("_text"))


def unpacked(columns: list[str], text_col: str, made: set[str]) -> list:
    """Select list that undoes packed(); columns named as ones that the operator makes give way."""
    return [(F.col("_text") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in columns if c not in made]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def releasing(run):
    """A function for mapInArrow that gives the memory which Arrow holds in reserve back when a task ends.

    Spark keeps idle Python processes for later tasks, while its joins need the memory.
    """

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return released


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges of at most so many bytes each; a longer text stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        room = SMALL_CHUNK_BYTES if n <= SMALL_CHUNK_BYTES + 1 else CHUNK_BYTES
        step = np.full(max(n, room + 1), _BASE if kind == "base" else _INVERSE)
        step[0] = 1
        _powers[kind] = have = np.cumprod(step, dtype=np.uint64)
    return have[:n]


class Rolling:
    """Polynomial hashes, modulo 2^64, of any byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("base", len(data)), out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _power("inverse", len(self.sums))[start])

    def grams(self, k: int) -> np.ndarray:
        """Of every k bytes in turn."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * _power("inverse", n)) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w values in turn, by doubling."""
    n, size = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n]) if size < w else x[:n]


def word_table(*ranges: tuple[int, int]) -> np.ndarray:
    """For each byte: whether it belongs to a word; ranges are of bytes that separate."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on lower-cased text, and `[^\x20\x09-\x0D]+`.
ALNUM_WORDS = word_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SPACED_WORDS = word_table((0x20, 0x20), (0x09, 0x0D))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased data, and for each text the index of its first word (n + 1 values)."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in turn, from the hashes of the words."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return word_hash[:0]
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += word_hash[i : i + n]
    return mix(out)
