"""Quality classifier by weak labels: heuristic labellers, a model of their accuracies, and a hashed linear scorer.

1. Each labeller votes good, bad or not at all on a text. All texts' votes are counted by pattern: there are at most 3 ** labellers
   patterns, however many texts.
2. Expectation-maximisation over the counted patterns estimates how often each labeller is right about good and about bad texts,
   and each pattern's posterior probability of a good text.
3. A linear scorer over hashed word shapes is trained on the posteriors of all texts: a bucket's weight is the log ratio of its
   share among good texts and its share among bad ones, from sums by bucket. A text's score is the mean weight of its words.
4. Where the scorer draws the line is set on the posteriors again: the threshold, of a fixed grid, with the least expected
   error. A text is rejected below it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.llm.common import SMALL_CHUNK_BYTES, SPACED_WORDS, Rolling, buffers, chunks, mix, packed, releasing, unpacked, words

BUCKETS = 1 << 14
#: The first six find one kind of junk and never vote good; the others judge the text as a whole.
LABELLERS = ("symbols", "capitals", "repeats", "runs", "tables", "marks", "plain", "variety", "lengths")
DETECTORS = 6
ROUNDS = 100
#: What the belief that labellers are right weighs against the votes.
BELIEF = 1.0
#: A text's score has so many words of a good text's mean weight in it, so that a few words alone don't decide.
PRIOR_WORDS = 5
#: Bins that scores are counted in to set the threshold: of 1/16 from -8 to 8.
BINS, STEP = 256, 1 / 16

_SYMBOLS = np.isin(np.arange(256), list(b"#$%&*+/<=>@\\^_`{|}~"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values between each two of the places in ``first``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def votes_and_shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: votes (texts x labellers; 1 good, -1 bad, 0 none), buckets of all words, and each text's first word (n + 1)."""
    starts, ends, first = words(data, offsets, SPACED_WORDS)
    n_words, n_bytes = np.maximum(np.diff(first), 1), np.maximum(np.diff(offsets), 1)
    hashes = Rolling(data).ranges(starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    _, one = np.unique(mix(hashes ^ mix(text.astype(np.uint64))), return_index=True)
    distinct = np.bincount(text[one], minlength=len(offsets) - 1)
    letters = np.maximum(_per_text(_LETTER[data], offsets), 1)
    last = data[ends - 1] if len(ends) else data[:0]
    doubled = (last == 33) & (data[np.maximum(ends - 2, 0)] == 33) if len(ends) else again
    letters_of = np.concatenate([[0], np.cumsum(_LETTER[data])])
    upper_of = np.concatenate([[0], np.cumsum(_UPPER[data])])
    size, lettered, capital = ends - starts, letters_of[ends] - letters_of[starts], upper_of[ends] - upper_of[starts]
    plain = (lettered >= 1) & (size - lettered <= 1) & (capital <= 1)  # letters, one mark and one capital at most
    shares = {
        "symbols": (_per_text(_SYMBOLS[data], offsets) / n_bytes, 0, 0.04),
        "capitals": (_per_text(_UPPER[data], offsets) / letters, 0, 0.4),
        "repeats": (_per_text(again, first) / n_words, 0, 0.25),
        "runs": (_per_text(again & np.roll(again, 1), first) / n_words, 0, 0.1),
        "tables": (_per_text((data == 124) | (data == 9), offsets) / n_words, 0, 0.1),
        "marks": (_per_text(doubled, first) / n_words, 0, 0.1),
        "plain": (1 - _per_text(plain, first) / n_words, 0.15, 0.35),
        "variety": (1 - distinct / np.minimum(n_words, 4096), 0.6, 0.8),
        "lengths": (np.abs(n_bytes / n_words - 7), 4, 20),
    }
    wordless = np.diff(first) == 0
    votes = np.stack([np.where(wordless, 0, np.where(x >= bad, -1, np.where((x <= good) & (i >= DETECTORS), 1, 0))) for i, (x, good, bad) in enumerate(shares[k] for k in LABELLERS)], 1)
    code = _CLASS[last] if len(ends) else _CLASS[:0]
    code = code * np.uint64(257) + _CLASS[data[np.maximum(ends - 2, starts)]] if len(ends) else code
    code = code * np.uint64(257) + _CLASS[data[starts]] if len(ends) else code
    code = code * np.uint64(16) + np.minimum((ends - starts) // 3, 15).astype(np.uint64)
    code = code * np.uint64(2) + again.astype(np.uint64)
    return votes.astype(np.int8), (mix(code) % np.uint64(BUCKETS)).astype(np.int64), first


def _patterns(votes: np.ndarray) -> np.ndarray:
    """One number for each text's votes."""
    return ((votes.astype(np.int64) + 1) * 3 ** np.arange(len(LABELLERS))).sum(1)


def posteriors(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[dict[int, float], np.ndarray]:
    """Probability of a good text for each pattern of votes; labellers x (bad, good) x (vote bad, none, vote good) rates.

    Labellers are taken to vote apart of each other, given what the text is, and to be right more often than wrong: that belief
    counts as much as the votes, so a rare kind of junk isn't taken for good because most junk looks otherwise. Texts
    without any vote have even odds and don't count.
    """
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[p] for p in patterns.tolist()], float)
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3  # 0 bad, 1 none, 2 good
    belief = np.array([[0.4, 0.4, 0.2], [0.04, 0.48, 0.48]])
    rates = np.tile(belief, (len(LABELLERS), 1, 1))
    prior, silent = 0.8, (votes == 1).all(1)
    weight[silent] = 0
    good = np.full(len(patterns), prior)
    for _ in range(rounds if weight.sum() else 0):
        log = np.log(rates)[np.arange(len(LABELLERS)), :, votes].sum(1)  # patterns x (bad, good)
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1] + math.log((1 - prior) / prior), -500, 500)))
        prior = float(np.clip((weight * good).sum() / weight.sum(), 0.01, 0.99))
        for k, share in enumerate((1 - good, good)):
            seen = np.stack([(weight * share) @ (votes == v) for v in range(3)], 1) + ((weight @ share) * BELIEF + 1) * belief[k]
            rates[:, k] = seen / seen.sum(1, keepdims=True)
    good[silent] = 0.5
    return dict(zip(patterns.tolist(), good.tolist(), strict=True)), rates


@dataclass
class Model:
    """What executors need: posteriors by pattern, weights by bucket, their mean in good texts, threshold."""

    posterior: dict[int, float]
    weights: np.ndarray
    usual: float
    threshold: float


def _chunked(batches: Iterator[pa.RecordBatch]):
    """(batch, patterns, buckets, first) of a batch's texts in chunks; first counts from the chunk's own words."""
    for batch in batches:
        data, offsets = buffers(batch.column("_text"))
        for i, j in chunks(offsets, SMALL_CHUNK_BYTES):
            votes, shapes, first = votes_and_shapes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield _patterns(votes), shapes, first


def _count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found, _, _ in _chunked(batches):
        pattern, n = np.unique(found, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], ["pattern", "n"])


def _sum_buckets(posterior: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each text weighs the same, however long.
        good, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for found, shapes, first in _chunked(batches):
            p = np.array([posterior[x] for x in found.tolist()])
            n = np.diff(first)
            each = np.repeat(p / np.maximum(n, 1), n), np.repeat((1 - p) / np.maximum(n, 1), n)
            good += np.bincount(shapes, each[0], BUCKETS)
            bad += np.bincount(shapes, each[1], BUCKETS)
        used = np.flatnonzero((good > 0) | (bad > 0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(good[used]), pa.array(bad[used])], ["bucket", "good", "bad"])

    return run


def text_scores(shapes: np.ndarray, first: np.ndarray, weights: np.ndarray, usual: float) -> np.ndarray:
    """Mean weight of each text's words and PRIOR_WORDS usual ones."""
    total = np.concatenate([[0.0], np.cumsum(weights[shapes])])
    return (total[first[1:]] - total[first[:-1]] + PRIOR_WORDS * usual) / (np.diff(first) + PRIOR_WORDS)


def _bins(posterior: dict[int, float], weights: np.ndarray, usual: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = np.zeros(BINS), np.zeros(BINS)
        for found, shapes, first in _chunked(batches):
            p = np.array([posterior[x] for x in found.tolist()])
            at = np.clip(np.floor(text_scores(shapes, first, weights, usual) / STEP).astype(np.int64) + BINS // 2, 0, BINS - 1)
            good += np.bincount(at, p, BINS)
            bad += np.bincount(at, 1 - p, BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(good), pa.array(bad)], ["bin", "good", "bad"])

    return run


def learn(docs: DataFrame, text_col: str = "text") -> Model:
    """From all texts of docs, without any labels. What comes to the driver are counts by pattern, bucket and bin, of fixed number."""
    rows = docs.select(F.col(f"`{text_col}`").alias("_text"))
    counts = {r.pattern: r.n for r in rows.mapInArrow(releasing(_count_patterns), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    posterior, _ = posteriors(counts)
    sums = np.zeros((2, BUCKETS))
    for r in rows.mapInArrow(releasing(_sum_buckets(posterior)), "bucket long, good double, bad double").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect():
        sums[:, r.bucket] = r.good, r.bad
    # A bucket that was hardly seen says little: shares are smoothed by what a fiftieth of a text's words weighs.
    share = (sums + 0.02) / (sums.sum(1, keepdims=True) + 0.02 * BUCKETS)
    weights = np.log(share[0] / share[1])
    usual = float(share[0] @ weights)
    binned = np.zeros((2, BINS))
    for r in rows.mapInArrow(releasing(_bins(posterior, weights, usual)), "bin long, good double, bad double").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect():
        binned[:, r.bin] = r.good, r.bad
    # Below bin i all is rejected: good texts lost there, bad ones kept from there on.
    error = np.concatenate([[0], np.cumsum(binned[0])]) + binned[1].sum() - np.concatenate([[0], np.cumsum(binned[1])])
    best = np.flatnonzero(error <= error.min() + 1e-9)
    return Model(posterior, weights, usual, (int(best[0]) - BINS // 2) * STEP if error.min() < error[0] else -math.inf)


def _judge(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            votes, p, score = [], [], []
            for i, j in chunks(offsets, SMALL_CHUNK_BYTES):
                v, shapes, first = votes_and_shapes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                votes += v.tolist()
                p += [model.posterior.get(x, 0.5) for x in _patterns(v).tolist()]
                score += text_scores(shapes, first, model.weights, model.usual).tolist()
            kept = [s >= model.threshold for s in score]
            made = [pa.array(votes, pa.list_(pa.int32())), pa.array(p, pa.float64()), pa.array(score, pa.float64()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_text"), *made], ["_row", "_text", "votes", "posterior", "score", "kept"])

    return run


def judged(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """docs with votes (one for each of LABELLERS), posterior (of a good text by its votes), score and kept.

    Null, empty and blank texts get no votes and the usual score of a good text, and are kept. Equal texts are judged alike. Columns of
    docs that are named as one made here are replaced; an empty table gives an empty result.
    """
    model = model or learn(docs, text_col)
    rows = packed(docs, text_col)
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, _text string, votes array<int>, posterior double, score double, kept boolean"
    out = rows.mapInArrow(releasing(_judge(model)), schema)
    made = {"votes", "posterior", "score", "kept"}
    return out.select(*unpacked(docs.columns, text_col, made), "votes", "posterior", "score", "kept")
