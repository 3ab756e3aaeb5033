"""Toxicity by compression distance: how much shorter a window of text gets with a dictionary of toxic passages.

Two zstandard dictionaries are trained on labelled texts. Both hold ordinary words; the toxic one has, in place of the rarer
ordinary ones, words that tell toxic texts from ordinary ones: those that have a stem for which the log-likelihood ratio of
document counts is at least ``EVIDENCE``. A window is a word with its boundaries. Each byte is written as three, so that a match
saves more than the few bytes that it costs; and fixed padding around it keeps so short an input from being stored raw.

A window falls into a cell by the two lengths: what the toxic dictionary saves, and what is left. Cells have log odds, from
texts that the dictionaries were not trained on (two folds), and a text's highest log odds go through a logistic function fitted
on the same; a text is called toxic from a score of 0.5 on.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.llm.common import LOWER, buffers, packed, unpacked

#: Labelled texts that are learnt from, at most, of each label: those of least hash.
SAMPLE = 1500, 3000
ORDINARY_BYTES, TOXIC_BYTES = 20_000, 20_000
LEVEL = 12
EVIDENCE = 12.0
STEMS = (4, 5, 6)
_PAD = b"\n" * 48
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TRIPLE = {b: bytes((b, (b + 85) & 255, (b + 170) & 255)) for b in range(256)}
_CACHE = 1 << 18


def distinct_words(text: bytes) -> list[bytes]:
    """The words of a text that has been lower-cased, in order of first occurrence."""
    return list(dict.fromkeys(_WORD.findall(text)))


def _wide(text: bytes) -> bytes:
    return b"".join([_TRIPLE[b] for b in text])


def _stems(word: bytes) -> list[tuple[bytes, bool]]:
    return [(word, False), *((word[:k], True) for k in STEMS if len(word) > k)]


def _telling(texts: list[tuple[list[bytes], int]]) -> set[tuple[bytes, bool]]:
    """Stems (and whole words) that mark toxic texts."""
    with_stem, size = (Counter(), Counter()), [0, 0]
    for words, label in texts:
        with_stem[label].update({s for w in words for s in _stems(w)})
        size[label] += 1
    share = size[1] / max(1, sum(size))
    found = set()
    for stem, toxic in with_stem[1].items():
        ordinary = with_stem[0][stem]
        n = toxic + ordinary
        if toxic >= 3 and toxic > n * share:
            ratio = toxic * math.log(toxic / (n * share)) + (ordinary * math.log(ordinary / (n * (1 - share))) if ordinary else 0)
            if 2 * ratio >= EVIDENCE:
                found.add(stem)
    return found


def _content(counts: Counter, size: int) -> list[bytes]:
    """The most frequent words up to a size, rarer ones first, as zstandard prefers what stands last."""
    out, n = [], 0
    for word, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        n += len(word) + 1
        if n > size:
            break
        out.append(word)
    return out[::-1]


def train_dictionaries(texts: list[tuple[list[bytes], int]]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary, of about the same length, from (words, label) of texts."""
    telling = _telling(texts)
    counts = Counter(), Counter()
    for words, label in texts:
        for w in words:
            if any(s in telling for s in _stems(w)):
                counts[1][w] += 1
            elif not label:
                counts[0][w] += 1
    toxic = _content(counts[1], TOXIC_BYTES)
    extra = sum(len(w) + 1 for w in toxic)
    join = lambda words: b" " + b" ".join(words) + b" "
    return join(_content(counts[0], ORDINARY_BYTES + extra)), join(_content(counts[0], ORDINARY_BYTES) + toxic)


class Distance:
    """Cells of windows under two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.compressors = []
        for content in (ordinary, toxic):
            held = zstandard.ZstdCompressionDict(_PAD + _wide(content) + _PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.least = len(self.compressors[1].compress(_PAD + _PAD))
        self.seen: dict[bytes, int] = {}

    def cell(self, word: bytes) -> int:
        """Number of the window's cell; a window is compressed once while it is remembered."""
        found = self.seen.get(word)
        if found is None:
            window = _PAD + _wide(b" " + word + b" ") + _PAD
            left = len(self.compressors[1].compress(window))
            saved = len(self.compressors[0].compress(window)) - left
            found = max(-1, min(saved, 30) // 2) * 16 + max(0, min(left - self.least, 45) // 3)
            if len(self.seen) >= _CACHE:
                self.seen.clear()
            self.seen[word] = found
        return found


def _features(cells: list[int], odds: dict[int, float]) -> list[float]:
    """The three highest log odds of a text's windows, how many are high, and a constant."""
    best = sorted((odds.get(c, 0.0) for c in cells), reverse=True)
    return [*(max(x, -1.0) for x in [*best[:3], -1.0, -1.0, -1.0][:3]), math.log1p(sum(x > 1.5 for x in best)), 1.0]


def _logistic(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights by Newton's method with a slight ridge."""
    w = np.zeros(rows.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        w -= np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + 0.1 * np.eye(len(w)), rows.T @ (p - labels) + 0.1 * w)
    return w


@dataclass
class Model:
    """What executors need to score texts."""

    ordinary: bytes
    toxic: bytes
    odds: dict[int, float]
    weights: list[float]


def fit(texts: list[tuple[bytes, int]]) -> Model:
    """From lower-cased texts and their labels; without texts of both labels every text gets the share of toxic ones."""
    prepared = [(distinct_words(t), y) for t, y in texts]
    share = (sum(y for _, y in texts) + 0.5) / (len(texts) + 1)
    if len({y for _, y in texts}) < 2:
        return Model(b" ", b" ", {}, [0.0, 0.0, 0.0, 0.0, math.log(share / (1 - share))])
    fold = [zlib.crc32(t) & 1 for t, _ in texts]
    cells: list[tuple[list[int], int]] = []
    for f in (0, 1):
        distance = Distance(*train_dictionaries([x for x, g in zip(prepared, fold, strict=True) if g != f]))
        cells += [([distance.cell(w) for w in words], y) for (words, y), g in zip(prepared, fold, strict=True) if g == f]
    seen, size = (Counter(), Counter()), [0, 0]
    for found, y in cells:
        seen[y].update(set(found))
        size[y] += 1
    rate = lambda c, y: math.log((seen[y][c] + 0.5) / (size[y] + 1))
    odds = {c: rate(c, 1) - rate(c, 0) for c in seen[0].keys() | seen[1].keys()}

    weights = _logistic(np.array([_features(c, odds) for c, _ in cells]), np.array([y for _, y in cells], float))
    return Model(*train_dictionaries(prepared), odds, weights.tolist())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most SAMPLE labelled texts of each label, those whose ids have the least hashes; the sample is all that leaves Spark.

    Texts without a label, and labels without a text, don't count; of equal texts one does. Where SAMPLE cuts one label more than
    the other, the model's constant is corrected from the sample's odds to those of all labels.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) != 0).cast("int").alias("_label"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    chosen = None
    for label, most in ((1, SAMPLE[0]), (0, SAMPLE[1])):
        # Ids first, so that only the texts of the sample are moved.
        ids = known.where(F.col("_label") == label).orderBy(F.xxhash64(F.col("_id")), "_id").limit(most)
        chosen = ids if chosen is None else chosen.unionByName(ids)
    found = rows.join(F.broadcast(chosen), "_id").groupBy(F.md5("_text").alias("_key")).agg(F.first("_text").alias("_text"), F.max("_label").alias("_label"))
    table = bytes(LOWER.tolist())
    sample = [(r._text.encode().translate(table), r._label) for r in found.orderBy("_key").collect()]  # SAMPLE texts at most
    model = fit(sample)
    if len({y for _, y in sample}) == 2:
        size = {r._label: r["count"] for r in known.groupBy("_label").count().collect()}
        drawn = [min(size[y], SAMPLE[1 - y]) for y in (0, 1)]
        model.weights[-1] += math.log(size[1] / size[0]) - math.log(drawn[1] / drawn[0])
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance, weights = Distance(model.ordinary, model.toxic), np.array(model.weights)
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            data = LOWER[data]
            scores: list[float] = []
            seen: dict[bytes, float] = {}
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = data[a:b].tobytes()
                if text not in seen:
                    z = float(np.dot(weights, _features([distance.cell(w) for w in distinct_words(text)], model.odds)))
                    seen[text] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                scores.append(seen[text])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_text"), pa.array(scores, pa.float64())], ["_row", "_text", "score"])

    return run


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: toxic likelier) and predicted (1 from 0.5 on, else 0).

    Only the text counts, so rows that repeat have equal scores; a very long text is one row's work. Null, empty and wordless texts
    get the score of a text without any evidence. Columns of docs that are named as one of the two are replaced; an empty table
    gives an empty result.
    """
    rows = packed(docs, text_col)
    out = rows.mapInArrow(_score(model), f"_row {rows.schema['_row'].dataType.simpleString()}, _text string, score double")
    return out.select(*unpacked(docs.columns, text_col, {"score", "predicted"}), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
