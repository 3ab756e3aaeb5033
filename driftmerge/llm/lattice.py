"""Language-model scores from a subword lattice: the marginal probability of a text over all its segmentations.

The pieces are those of an existing vocabulary. Their probabilities start from its scores (ranks, so p ~ 1 / rank) and are set by
expected counts over all segmentations of all training words, in ``ROUNDS`` passes over the table of distinct words. A word,
with a mark before it, gets its probability by a forward recursion in log space over the pieces that match at each place; byte
pieces make every word reachable. The lattice of a word that was seen in training has one edge more, for the word as a whole: it
weighs by the word's count, and all such edges together have the Good-Turing share of what isn't new. A text is its words and
one end.

Counts of words grow with the corpus, so they stay in Spark: the ``HEAD`` most frequent words at most are broadcast, and other
words are looked up by a join on the word. Rare words have no hot keys; sums by text are combined before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.llm.common import LOWER, SPACED_WORDS, Rolling, buffers, chunks, stage, words
from driftmerge.llm.pieces import MARK, VOCABULARY, Vocabulary

#: Words that are broadcast, at most; each takes 32 bytes.
HEAD = 100_000
ROUNDS = 2
#: Probability of each byte piece to begin with, and the least that any piece keeps.
FLOOR = 1e-8
#: Bits of a hash by which pieces are looked up; 32k pieces take 3 % of as many places.
FIRST_BITS = 20
_MARK = np.frombuffer(MARK.encode(), np.uint8)


@dataclass
class Pieces:
    """Hashes of pieces in order, with their log probabilities (natural), and the lengths that pieces have."""

    hashes: np.ndarray
    log: np.ndarray
    sizes: list[int]

    @staticmethod
    def load(path: str = VOCABULARY) -> Pieces:
        vocabulary = Vocabulary.load(path)
        texts = [t.encode() for t in vocabulary.pieces] + [bytes([b]) for b in range(256)]
        weight = [1 / (10 + min(-s, 1e6)) for _, s in vocabulary.pieces.values()] + [0.0] * 256
        best: dict[bytes, float] = {}
        for t, w in zip(texts, weight, strict=True):  # a byte that is a piece of its own is one piece
            best[t] = max(w, best.get(t, 0.0))
        texts = list(best)
        ends = np.cumsum([len(t) for t in texts])
        hashes = Rolling(np.frombuffer(b"".join(texts), np.uint8)).ranges(ends - np.array([len(t) for t in texts]), ends)
        order = np.argsort(hashes)
        pieces = Pieces(hashes[order], np.zeros(len(texts)), sorted({len(t) for t in texts}))
        return pieces.weighted(np.array([best[t] for t in texts])[order])

    def weighted(self, weight: np.ndarray) -> Pieces:
        p = np.maximum(weight / weight.sum(), FLOOR)
        return Pieces(self.hashes, np.log(p / p.sum()), self.sizes)


def marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some words of data one after another, each with a mark before it: bytes, starts, ends."""
    size = ends - starts + len(_MARK)
    to = np.cumsum(size)
    at = to - size
    out = np.empty(int(size.sum()), np.uint8)
    place = np.arange(len(out)) - np.repeat(at, size)
    inside = place >= len(_MARK)
    out[~inside] = _MARK[place[~inside]]
    out[inside] = data[(np.repeat(starts, size) + place - len(_MARK))[inside]]
    return out, at, to


def cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Some words of data as an array of bytes."""
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size)])
    out = data[np.arange(to[-1]) + np.repeat(starts - to[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(out)])


class Lattice:
    """Edges of the lattices of some words, all words at once."""

    def __init__(self, pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.pieces = pieces
        order = np.argsort(starts - ends, kind="stable")  # long words first, so those that go on are always the first ones
        self.order, self.starts, self.size = order, starts[order], (ends - starts)[order]
        roll, rest = Rolling(data), np.repeat(ends, ends - starts) - np.arange(len(data))
        self.edges = {}
        # The first piece of those that begin with the same bits; most strings are no pieces, and are ruled out here.
        begin = pieces.hashes >> np.uint64(64 - FIRST_BITS)
        first = np.full(1 << FIRST_BITS, -1, np.int32)
        first[begin[::-1]] = np.arange(len(begin) - 1, -1, -1)
        alike = int(np.unique(begin, return_counts=True)[1].max())
        for k in pieces.sizes:
            at = np.flatnonzero(rest >= k)
            if not len(at):
                break
            h = roll.ranges(at, at + k)
            found = first[h >> np.uint64(64 - FIRST_BITS)]
            maybe = np.flatnonzero(found >= 0)
            at, h, found = at[maybe], h[maybe], found[maybe]
            for _ in range(alike - 1):
                found += (pieces.hashes[found] != h) & (found < len(begin) - 1)
            edge = np.full(len(data), -1, np.int32)
            hit = pieces.hashes[found] == h
            edge[at[hit]] = found[hit]
            self.edges[k] = edge
        self.node = self.starts + order  # a word has one node more than bytes
        self.alpha = np.full(len(data) + len(starts), -np.inf)

    def forward(self) -> np.ndarray:
        """Natural log of each word's probability."""
        self.alpha[self.node] = 0.0
        for t in range(1, int(self.size.max(initial=0)) + 1):
            n = int(np.searchsorted(-self.size, -t, "right"))
            total = np.full(n, -np.inf)
            for k, edge in self.edges.items():
                if k > t:
                    break
                e = edge[self.starts[:n] + t - k]
                hit = np.flatnonzero(e >= 0)
                total[hit] = np.logaddexp(total[hit], self.alpha[self.node[hit] + t - k] + self.pieces.log[e[hit]])
            self.alpha[self.node[:n] + t] = total
        out = np.zeros(len(self.order))
        out[self.order] = self.alpha[self.node + self.size]
        return out

    def expected(self, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece when each word comes so often; after forward()."""
        beta = np.full(len(self.alpha), -np.inf)
        beta[self.node + self.size] = 0.0
        total, log = self.alpha[self.node + self.size], self.pieces.log
        uses, weight = np.zeros(len(log)), counts[self.order]
        for t in range(int(self.size.max(initial=0)) - 1, -1, -1):
            n = int(np.searchsorted(-self.size, -t, "left"))  # words longer than t
            back = np.full(n, -np.inf)
            for k, edge in self.edges.items():
                longer = n if k == 1 else int(np.searchsorted(-self.size, -(t + k), "right"))
                if not longer:
                    break
                e = edge[self.starts[:longer] + t]
                hit = np.flatnonzero(e >= 0)
                step = beta[self.node[hit] + t + k] + log[e[hit]]
                back[hit] = np.logaddexp(back[hit], step)
                uses += np.bincount(e[hit], weight[hit] * np.exp(self.alpha[self.node[hit] + t] + step - total[hit]), len(log))
            beta[self.node[:n] + t] = back
        return uses


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("_text"))
        data = LOWER[data]
        for i, j in chunks(offsets):
            part = data[offsets[i] : offsets[j]]
            starts, ends, _ = words(part, offsets[i : j + 1] - offsets[i], SPACED_WORDS)
            _, one, n = np.unique(Rolling(part).ranges(starts, ends), return_index=True, return_counts=True)
            if len(one):
                yield pa.RecordBatch.from_arrays([cut_out(part, starts[one], ends[one]), pa.array(n)], ["word", "n"])


def _expect(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(len(pieces.log))
        for batch in batches:
            data, offsets = buffers(batch.column("word"))
            n = np.asarray(batch.column("c")).astype(float)
            for i, j in chunks(offsets):
                lattice = Lattice(pieces, *marked(data, offsets[i:j], offsets[i + 1 : j + 1]))
                lattice.forward()
                uses += lattice.expected(n[i:j])
        used = np.flatnonzero(uses > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(uses[used])], ["piece", "uses"])

    return run


@dataclass
class Model:
    """pieces, counts of words (a table: word, c), the frequent words' hashes, counts and lattice scores, and totals of the training tokens."""

    pieces: Pieces
    counts: DataFrame
    least: int
    head: tuple[np.ndarray, np.ndarray, np.ndarray]
    texts: int
    tokens: int
    distinct: int
    known_share: float


def learn(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> Model:
    """Count the words of all of docs and set the pieces' probabilities by them; null counts as an empty text."""
    rows = docs.select(F.col(f"`{text_col}`").alias("_text"))
    counts = stage(rows.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))
    texts = rows.count()
    # Numbers of words by the power of two their counts reach: some 60 rows.
    by_size = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect()
    tokens, distinct, once = texts + sum(r.n for r in by_size), (texts > 0) + sum(r.words for r in by_size), sum(r.once for r in by_size)
    least, room = 1 << 62, HEAD
    for r in sorted(by_size, key=lambda r: -r.power):
        if r.words > room:
            break
        room -= r.words
        least = 1 << r.power
    found = [(bytes(r.word), r.c) for r in counts.where(F.col("c") >= least).collect()]  # HEAD words at most
    ends = np.cumsum([len(w) for w, _ in found], dtype=np.int64)
    hashes = Rolling(np.frombuffer(b"".join(w for w, _ in found), np.uint8)).ranges(ends - np.array([len(w) for w, _ in found], np.int64), ends) if found else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    pieces = Pieces.load(path)
    for _ in range(ROUNDS):
        uses = np.zeros(len(pieces.log))
        for r in counts.mapInArrow(_expect(pieces), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # a row for each piece
            uses[r.piece] = r.uses
        if uses.sum() > 0:
            pieces = pieces.weighted(uses)
    data, starts = np.frombuffer(b"".join(w for w, _ in found), np.uint8), ends - np.array([len(w) for w, _ in found], np.int64)
    logs = [Lattice(pieces, *marked(data, starts[i : i + 20_000], ends[i : i + 20_000])).forward() for i in range(0, len(found), 20_000)]
    head = hashes[order], np.array([c for _, c in found], np.int64)[order], np.concatenate([np.zeros(0), *logs])[order]
    return Model(pieces, counts, least, head, texts, tokens, distinct, 1 - (once + 1) / (tokens + 1))


def _score(pieces: Pieces, head: tuple[np.ndarray, np.ndarray, np.ndarray], texts: int, tokens: int, distinct: int, share: float):
    log_base = math.log10(tokens + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            data = LOWER[data]
            for i, j in chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, ends, first = words(part, offsets[i : j + 1] - offsets[i], SPACED_WORDS)
                hashes, one, which = np.unique(Rolling(part).ranges(starts, ends), return_index=True, return_inverse=True)
                # The end is a token like others, seen once in each training text; it is no word's lattice.
                ended = math.log10((texts + 1) / (tokens + 1))
                found = np.minimum(np.searchsorted(head[0], hashes), max(0, len(head[0]) - 1)) if len(head[0]) else np.zeros(len(one), np.int64)
                count = np.where(head[0][found] == hashes, head[1][found], 0) if len(head[0]) else np.zeros(len(one), np.int64)
                # Frequent words have their scores with them.
                new = np.flatnonzero(count == 0)
                lattice = head[2][found].copy() if len(head[0]) else np.zeros(len(one))
                lattice[new] = Lattice(pieces, *marked(part, starts[one[new]], ends[one[new]])).forward()
                score = np.logaddexp(math.log(1 - share) + lattice, np.log(np.maximum(share * count / max(tokens, 1), 1e-300))) / math.log(10)
                base = np.log10(count + 1) - log_base
                known = count > 0
                sums = [np.concatenate([[0.0], np.cumsum(np.where(known, x, 0.0)[which])]) for x in (known.astype(float), base, score)]
                a, b = first[:-1], first[1:]
                n_known, base_sum, score_sum = ((s[b] - s[a]) for s in sums)
                text = np.repeat(np.arange(j - i), np.diff(first))
                rare = np.flatnonzero(~known[which])
                pair, n = np.unique(text[rare] * len(one) + which[rare], return_counts=True)
                # The pairs are in the order of their texts; rare words are the new ones.
                owner, word = np.divmod(pair, max(1, len(one)))
                place = np.zeros(len(one), np.int64)
                place[new] = np.arange(len(new))
                entry = [cut_out(part, starts[one[new]], ends[one[new]]).take(pa.array(place[word])), pa.array(n), pa.array(lattice[word])]
                tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)), pa.StructArray.from_arrays(entry, ["word", "n", "lattice"]))
                made = [pa.array(np.diff(first) + 1), pa.array(n_known.round().astype(np.int64) + (texts > 0)), pa.array(base_sum + math.log10(texts + 1) - log_base), pa.array(score_sum + ended), tails]
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(i, j - i), *made], ["_row", "n_tokens", "n_known", "base_score", "score", "tail"])

    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, without their texts, with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    base_score is that of single words with add-one counts. Null and empty texts are an end alone. Without training texts the
    pieces keep the vocabulary's own weights. Columns of docs named as one made here are replaced; repeated rows stay apart.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c != text_col and c not in made]
    rows = docs.select(F.struct(F.lit(0).alias("_none"), *(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    run = _score(model.pieces, model.head, model.texts, model.tokens, model.distinct, model.known_share)
    first = rows.mapInArrow(run, f"_row {kind}, n_tokens long, n_known long, base_score double, score double, tail array<struct<word: binary, n: bigint, lattice: double>>")
    first = stage(first.withColumn("_nth", F.monotonically_increasing_id()))
    rare = model.counts.where(F.col("c") < model.least)
    tail = first.select("_nth", F.explode("tail").alias("t")).select("_nth", "t.*").join(rare, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    share, tokens = model.known_share, max(model.tokens, 1)
    base = F.log10(F.col("c") + 1) - math.log10(model.tokens + model.distinct + 1)
    # log(x + y) from log x, so that long words don't vanish.
    new = F.col("lattice") + math.log(1 - share)
    seen = F.log(F.col("c") * (share / tokens))
    both = F.when(F.col("c") == 0, new).otherwise(F.greatest(new, seen) + F.log1p(F.exp(F.least(new, seen) - F.greatest(new, seen))))
    sums = tail.groupBy("_nth").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * base).alias("b"), F.sum(F.col("n") * both / math.log(10)).alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = first.drop("tail").join(sums, "_nth", "left")
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in kept), "n_tokens", (F.col("n_known") + zero("k")).cast("bigint").alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"), (F.col("base_score") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"))
