"""SentencePiece encoding and decoding by Viterbi over a trie of distinct words.

Spaces become word marks and a mark is put before the text, as the vocabulary's own normaliser does. No piece has a mark after
another character, so a best segmentation never crosses the start of a marked word, and each distinct word needs to be segmented
once. A chunk's distinct words are sorted, which is the depth-first order of their trie, and forward scores up to the prefix that
a word shares with the one before are kept. A task remembers the words it has segmented, up to a bound in bytes; texts go
through in chunks and their words, ids and bytes are flat arrays, so memory doesn't grow with a batch.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm.common import buffers, chunks, packed, releasing, unpacked

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Segmented words that a task remembers, in bytes: of each its text, its ids and what a dictionary's entry takes.
REMEMBERED = 64 << 20
_ENTRY = 200
#: Ids whose texts are put together at a time.
_IDS = 1 << 20
_MARK = tuple(MARK.encode())


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model: (id, score) by text, ids of bytes, the text of each id, and every end of a piece with its score, minus infinity if it is no piece itself."""

    pieces: dict[str, tuple[int, float]]
    bytes: list[int]
    texts: list[str]
    byte_of: dict[int, int]
    tails: dict[str, float]
    unknown: float

    @staticmethod
    def load(path: str = VOCABULARY) -> Vocabulary:
        """From a SentencePiece model file; the vocabulary must have byte pieces and no piece with a mark inside."""
        import sentencepiece

        if not os.path.exists(path):
            raise FileNotFoundError(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, by_byte, texts, byte_of, none = {}, {}, [], {}, (-1, float("-inf"))
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            texts.append(text)
            if model.is_byte(i):
                by_byte[int(text[3:-1], 16)] = i
                byte_of[i] = int(text[3:-1], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in text.lstrip(MARK):
                    raise ValueError(f"a piece with a mark inside: {text!r}")
                pieces[text] = (i, model.get_score(i))
        if len(by_byte) != 256:
            raise ValueError("the vocabulary lacks pieces for bytes")
        tails = {t[i:]: pieces.get(t[i:], none)[1] for t in pieces for i in range(len(t))}
        return Vocabulary(pieces, [by_byte[b] for b in range(256)], texts, byte_of, tails, min(s for _, s in pieces.values()) - UNKNOWN_PENALTY)

    def id_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, one after another, and where those of each id begin (one value more than ids)."""
        parts = [bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(MARK, " ").encode() for i, t in enumerate(self.texts)]
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def marked_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts with their marks, as an array of bytes, and the index of each text's first word (n + 1 values).

    A text's words together are the text with a mark before it and marks for spaces; an empty text has none.
    """
    texts = pc.fill_null(texts, "")
    marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(MARK, pc.replace_substring(texts, " ", MARK), ""))
    data, offsets = buffers(marked)
    mark = np.zeros(len(data) + 3, bool)
    mark[3:-2] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
    first = mark[3:].copy()
    first[: len(data)] &= ~mark[: len(data)]  # not right after another mark
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first)
    places = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))]), np.searchsorted(starts, offsets)


def segment(words: Iterable[str], vocabulary: Vocabulary) -> Iterator[tuple[str, list[int], float]]:
    """(word, ids, score) of each of the distinct words, in sorted order.

    Of segmentations of equal score the one whose last piece is longest is taken, then likewise before it. A character without
    a piece costs the unknown score and becomes its bytes.
    """
    pieces, tail, unknown = vocabulary.pieces, vocabulary.tails.get, vocabulary.unknown
    best, start, held = [0.0], [0], ""
    for word in sorted(words):
        common = 0
        for a, b in zip(held, word, strict=False):
            if a != b:
                break
            common += 1
        del best[common + 1 :], start[common + 1 :]
        for end in range(common + 1, len(word) + 1):
            top, at = best[end - 1] + unknown, -1
            for begin in range(end - 1, -1, -1):
                score = tail(word[begin:end])
                if score is None:  # no piece ends so
                    break
                value = best[begin] + score
                if value >= top:
                    top, at = value, begin
            best.append(top)
            start.append(at)
        held = word
        ids: list[int] = []
        end = len(word)
        while end:
            at = start[end]
            if at < 0:
                ids += [vocabulary.bytes[b] for b in reversed(word[end - 1].encode())]
                end -= 1
            else:
                ids.append(pieces[word[at:end]][0])
                end = at
        ids.reverse()
        yield word, ids, best[len(word)]


class _Known:
    """Words that were segmented, with their ids in one flat array."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.ends, self.scores, self.size = array("i"), array("q", [0]), array("d"), 0

    def places(self, words: list[bytes]) -> np.ndarray:
        """Numbers of distinct words; what isn't known is segmented, after the others are forgotten if there are too many."""
        new = [w.decode() for w in words if w not in self.place]
        if new and self.size > REMEMBERED:
            self._clear()
            new = [w.decode() for w in words]
        for word, ids, score in segment(new, self.vocabulary):
            key = word.encode()
            self.place[key] = len(self.scores)
            self.ids.extend(ids)
            self.ends.append(len(self.ids))
            self.scores.append(score)
            self.size += len(key) + 4 * len(ids) + _ENTRY
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


def gathered(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of values one after another, those between ends[i] and ends[i + 1] for each i of which, and where each ends (with a 0 before)."""
    size = ends[which + 1] - ends[which]
    to = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(to[-1]) + np.repeat(ends[which] - to[:-1], size)], to


def _encode(held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(held.value)
        for batch in batches:
            for i, j in chunks(buffers(batch.column("_text"))[1]):
                part = batch.slice(i, j - i)
                words, first = marked_words(part.column("_text"))
                distinct = words.dictionary_encode()
                place = known.places(distinct.dictionary.to_pylist())[np.asarray(distinct.indices)]
                ids, to = gathered(np.frombuffer(known.ids, np.int32), np.frombuffer(known.ends, np.int64), place)
                score = np.bincount(np.repeat(np.arange(j - i), np.diff(first)), np.frombuffer(known.scores)[place], j - i)
                encoded = pa.ListArray.from_arrays(pa.array(to[first].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_text"), encoded, pa.array(score)], ["_row", "_text", "ids", "piece_score"])

    return run


def _joined(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, places: np.ndarray) -> pa.Array:
    """The texts of lists of ids: bytes together, marks as spaces, without the first mark. Bytes that are no UTF-8 become U+FFFD."""
    out, to = gathered(data, places, ids)
    begin, end = to[offsets[:-1]], to[offsets[1:]]
    begin += (end > begin) & (out[np.minimum(begin, max(0, len(out) - 1))] == 32) if len(out) else 0
    size = end - begin
    text_ends = np.concatenate([[0], np.cumsum(size)])
    kept = out[np.arange(text_ends[-1]) + np.repeat(begin - text_ends[:-1], size)]
    try:
        found = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(text_ends), pa.py_buffer(kept)])
        found.validate(full=True)
    except pa.ArrowInvalid:  # ids that don't come from a text
        found = pa.array([kept[a:b].tobytes().decode(errors="replace") for a, b in zip(text_ends[:-1].tolist(), text_ends[1:].tolist(), strict=True)], pa.large_string())
    return found.cast(pa.string())


def _decoded(lists: pa.ListArray, data: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, pa.Array]]:
    """(place, texts) of lists of ids, some lists at a time."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)), dtype=np.int64)])
    for i, j in chunks(offsets, _IDS):
        part = lists.slice(i, j - i)
        yield i, pc.if_else(part.is_null(), None, _joined(np.asarray(part.flatten()), offsets[i : j + 1] - offsets[i], data, places))


def _decode(held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, places = held.value.id_bytes()
        for batch in batches:
            for i, texts in _decoded(batch.column("_text"), data, places):
                part = batch.slice(i, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_text"), texts], ["_row", "_text", "decoded"])

    return run


def _round_trip(held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, places = held.value.id_bytes()
        for batch in _encode(held)(batches):
            for i, texts in _decoded(batch.column("ids"), data, places):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, len(texts)).columns, texts], [*batch.schema.names, "decoded"])

    return run


def _broadcast(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(Vocabulary.load(path))  # a vocabulary's size doesn't depend on the data


def encode(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """docs with ids (array<int>) and piece_score (sum of the pieces' scores).

    Null and empty texts have no ids and score 0. A very long text is one row's work and takes memory in proportion to itself.
    Ties between segmentations go by segment()'s rule, so rows that repeat get the same ids. Columns of docs that are named as
    one of the two are replaced; an empty table gives an empty result.
    """
    rows = packed(docs, text_col)
    out = rows.mapInArrow(_encode(_broadcast(docs.sparkSession, path)), f"_row {rows.schema['_row'].dataType.simpleString()}, _text string, ids array<int>, piece_score double")
    return out.select(*unpacked(docs.columns, text_col, {"ids", "piece_score"}), "ids", "piece_score")


def round_trip(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """decode(encode(docs)), both by one Python process for each core of an executor.

    One after the other they keep two processes for a core, and Spark hands later tasks to all of them in turn, so that each
    holds the memory of its largest task.
    """
    rows = packed(docs, text_col)
    made = "ids array<int>, piece_score double, decoded string"
    out = rows.mapInArrow(releasing(_round_trip(_broadcast(docs.sparkSession, path))), f"_row {rows.schema['_row'].dataType.simpleString()}, _text string, {made}")
    names = ["ids", "piece_score", "decoded"]
    return out.select(*unpacked(docs.columns, text_col, set(names)), *names)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """encoded with decoded, the text of its ids (null for null); a text that encode() was given comes back as it was.

    The exception are texts with word marks of their own, which come back as spaces. Rows that repeat stay; a column named
    decoded is replaced; ids outside the vocabulary raise IndexError in the job; an empty table gives an empty result.
    """
    rows = packed(encoded, ids_col)
    out = rows.mapInArrow(_decode(_broadcast(encoded.sparkSession, path)), f"_row {rows.schema['_row'].dataType.simpleString()}, _text array<int>, decoded string")
    return out.select(*unpacked(encoded.columns, ids_col, {"decoded"}), "decoded")
