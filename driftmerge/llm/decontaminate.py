"""Benchmark decontamination by winnowing.

Of each text, every window of 13 words keeps its k-gram of least hash as a fingerprint. Equal windows keep equal k-grams at
equal places, so a span of 13 words that a document shares with a benchmark item shares a fingerprint. Documents' fingerprints
are joined with the items', and each hit is extended to both sides, word by word; runs of 13 words or more are contaminated.
Items of fewer words have one window, the whole item, and are looked up by the hash of so many words.

The items' side is the smaller: it goes to the workers in blocks of at most ``block_bytes`` of text, one pass over the
documents' rows for each block and no shuffle of documents, however large the benchmark is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.llm.common import ALNUM_WORDS, LOWER, Rolling, buffers, chunks, packed, shingle_hashes, sliding_min, unpacked, words

WINDOW = 13
GRAM = 8
BLOCK_BYTES = 32 << 20


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the index of each text's first word (n + 1 values)."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets, ALNUM_WORDS)
    return Rolling(data).ranges(starts, ends), first


def fingerprints(word_hash: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are least in some window of ``window`` words within one text."""
    g = shingle_hashes(word_hash, gram)
    span = window - gram + 1
    least = sliding_min(g, span)
    if not len(least):
        return np.zeros(0, np.int64), g[:0]
    mark = np.zeros(len(word_hash) + 1, np.int32)
    full = np.diff(first) >= window
    np.add.at(mark, first[:-1][full], 1)
    np.add.at(mark, first[1:][full] - window + 1, -1)
    valid = np.cumsum(mark)[: len(least)] > 0
    chosen = np.zeros(len(g), bool)
    for i in range(span):
        chosen[i : i + len(least)] |= valid & (g[i : i + len(least)] == least)
    at = np.flatnonzero(chosen)
    return at, g[at]


#: Runs of more equal fingerprints than this, one word from the next, come from one word repeated.
_MANY = 16


def thinned(at: np.ndarray, hashes: np.ndarray, step: int) -> np.ndarray:
    """Which fingerprints, in the order of their places, are worth looking at: of long runs the first and last ones, and every step-th between if step isn't 0.

    A run is one word repeated, more than a window of it. Two such runs match at their aligned ends, which the first and last places
    find, or somewhere inside, where a place in every step of the one and the first of the other cover all that any two would.
    """
    start = np.ones(len(at), bool)
    start[1:] = (np.diff(at) != 1) | (hashes[1:] != hashes[:-1])
    run = np.cumsum(start) - 1
    first = np.flatnonzero(start)
    size = np.diff(np.append(first, len(at)))
    nth = np.arange(len(at)) - first[run] if len(at) else at
    kept = (size[run] <= _MANY) | (nth == 0) | (nth == size[run] - 1)
    return kept | (nth % step == 0) if step else kept


class Index:
    """Fingerprints and words of a block of items."""

    def __init__(self, ids: list[str], texts: list[str], window: int, gram: int):
        data = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)]).astype(np.int64)
        self.ids, self.window, self.gram = ids, window, gram
        self.words, self.first = hashed_words(np.frombuffer(b"".join(data), np.uint8), offsets)
        self.at, hashes = fingerprints(self.words, self.first, window, gram)
        kept = thinned(self.at, hashes, 0)
        self.at, hashes = self.at[kept], hashes[kept]
        order = np.argsort(hashes, kind="stable")
        self.at, self.hashes = self.at[order], hashes[order]
        self.item = np.searchsorted(self.first, self.at, "right") - 1
        n = np.diff(self.first)
        self.short = {}
        for size in sorted(set(n[(n > 0) & (n < window)].tolist())):
            items = np.flatnonzero(n == size)
            key = np.array([shingle_hashes(self.words[self.first[i] : self.first[i] + size], size)[0] for i in items], np.uint64)
            order = np.argsort(key, kind="stable")
            self.short[size] = (key[order], items[order])

    def hits(self, word_hash: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, item) of runs of words that an item's windows cover."""
        starts, ends, items = [], [], []
        at, hashes = fingerprints(word_hash, first, self.window, self.gram)
        kept = thinned(at, hashes, self.window - self.gram + 1)
        at, hashes = at[kept], hashes[kept]
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        which = np.repeat(np.arange(len(at)), high - low)
        if len(which):
            entry = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            here, there, item = at[which], self.at[entry], self.item[entry]
            text = np.searchsorted(first, here, "right") - 1
            left = self._extend(word_hash, here - 1, there - 1, first[text], self.first[item], -1)
            right = self._extend(word_hash, here + self.gram, there + self.gram, first[text + 1] - 1, self.first[item + 1] - 1, 1)
            run = left + self.gram + right
            keep = (run >= self.window) & (self._extend(word_hash, here, there, here + self.gram - 1, there + self.gram - 1, 1) == self.gram)
            starts.append((here - left)[keep])
            ends.append((here + self.gram + right)[keep])
            items.append(item[keep])
        for size, (key, short) in self.short.items():
            g = shingle_hashes(word_hash, size)
            place = np.flatnonzero(np.isin(g, key))
            place = place[place + size <= first[np.searchsorted(first, place, "right")]]
            low, high = np.searchsorted(key, g[place], "left"), np.searchsorted(key, g[place], "right")
            which = np.repeat(np.arange(len(place)), high - low)
            entry = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            starts.append(place[which])
            ends.append(place[which] + size)
            items.append(short[entry])
        if not starts:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(items)

    def _extend(self, word_hash, here, there, here_end, there_end, step) -> np.ndarray:
        """How many words in turn are equal from here (a document) and there (an item) on, up to both ends."""
        length = np.zeros(len(here), np.int64)
        most = np.minimum((here_end - here) * step, (there_end - there) * step) + 1
        active = np.flatnonzero(most > 0)
        while len(active):
            n = length[active] * step
            active = active[word_hash[here[active] + n] == self.words[there[active] + n]]
            length[active] += 1
            active = active[length[active] < most[active]]
        return length


def _search(index: Broadcast, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            before_spans, before_items = batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()
            n_words, spans, items = np.zeros(len(batch), np.int64), [], []
            for i, j in chunks(offsets):
                word_hash, first = hashed_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n_words[i:j] = np.diff(first)
                start, end, item = index.value.hits(word_hash, first)
                text = np.searchsorted(first, start, "right") - 1
                order = np.lexsort((start, text))
                start, end, item, text = start[order] - first[text[order]], end[order] - first[text[order]], item[order], text[order]
                cut = np.searchsorted(text, np.arange(j - i + 1))
                for row, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True), i):
                    spans.append((before_spans[row] or b"") + (np.stack([start[x:y], end[x:y]], 1).astype(np.int64).tobytes() if y > x else b""))
                    items.append(sorted({*(before_items[row] or ()), *(index.value.ids[k] for k in set(item[x:y].tolist()))}))
            columns = [batch.column("_row"), batch.column("_text")]
            if not last:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["_row", "_text", "_spans", "_items"])
                continue
            n_hit = [covered(np.frombuffer(s, np.int64).reshape(-1, 2)) for s in spans]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            bad = [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(sha), pa.array(bad, pa.bool_())], ["_row", "_text", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])

    return run


def covered(spans: np.ndarray) -> int:
    """Words in the union of [start, end) spans."""
    total, reach = 0, 0
    for s, e in sorted(map(tuple, spans.tolist())):
        total += max(0, e - max(s, reach))
        reach = max(reach, e)
    return total


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted ids as strings), items_sha256 and contaminated.

    A document is contaminated if words of items' windows are a twentieth of its words or more. Null or empty texts have no
    words and are clean; items without words match nothing; a null item id counts as the empty string, items with one id as
    one. Words that repeat very often are looked at in a few places of their run only, with the same hits. A very long text is one
    row's work; rows that repeat stay. An empty table on either side gives clean documents or none. Columns of docs that are named as one made here are
    replaced.
    """
    made = {"n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"}
    spark = docs.sparkSession
    bench = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text")).distinct()
    size = bench.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out = packed(docs, text_col).withColumns({"_spans": F.lit(None).cast("binary"), "_items": F.lit(None).cast("array<string>")})
    row = out.schema["_row"].dataType.simpleString()
    for i in range(blocks):
        block = bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i).collect()  # of block_bytes, or one item
        index = spark.sparkContext.broadcast(Index([r.id for r in block], [r.text for r in block], window, gram))
        last = i == blocks - 1
        out = out.mapInArrow(_search(index, last), f"_row {row}, _text string, " + ("n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean" if last else "_spans binary, _items array<string>"))
    return out.select(*unpacked(docs.columns, text_col, made), "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")
