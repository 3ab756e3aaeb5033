"""Exact substring dedup with an enhanced suffix array over sampled suffixes.

A repeat of ``min_len`` bytes or more is found where both copies hold it in full:

1. Each window of min_len bytes has one anchor, its k-gram of least hash (rightmost on ties). The choice depends on the
   window's bytes only, so equal windows have anchors at equal offsets. An anchor owns a run of windows: its context.
2. Anchors with a k-gram that no other anchor has own no repeated window and end here. Where all contexts under a k-gram are
   equal, every owned window repeats. Both are settled by counting hashes.
3. The rest are the ends of repeats. One context of each kind goes to the k-gram's bucket, where the suffixes that start owned
   windows are sorted into an array with common-prefix lengths. A stack scan builds the interval tree; each interval of
   min_len or more whose left neighbours differ is a maximal repeat, reported for all its occurrences.
4. A bucket of more than ``bucket_limit`` kinds is not gathered: its windows are counted by hash, with partial sums, block by block.
   What all windows of a block have in common decides that none repeats, all that they cover together that each does; only blocks
   in between are looked at in smaller ones.

Every key is spread by hash; k-grams and kinds that very many texts have are joined by broadcast, at most HOT of them, and groups
are only gathered below the limit. Equality of contexts is by 64-bit hashes within one k-gram's bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.llm.common import Rolling, buffers, chunks, join_hot, mix, packed, sliding_min, stage, unpacked

MIN_LEN = 400
BUCKET_LIMIT = 512
#: Windows in a block of a crowded bucket, from level to level.
BLOCKS = (16, 4, 1)
_SUFFIXES = 60_000
_CONTEXT = ("gram", "kind", "rel", "left", "context")


def _anchors(data: np.ndarray, offsets: np.ndarray, min_len: int):
    """For each run of windows with one anchor: text row, anchor, first and last window start, hash of the k-gram and of the context. Positions in data."""
    k = max(1, min_len // 4)
    n = len(data) - min_len + 1
    if n <= 0:
        return None
    roll = Rolling(data)
    place = np.arange(len(data) - k + 1, dtype=np.uint64)
    low = np.uint64(max(24, int(len(data)).bit_length()))
    packed_hash = (roll.grams(k) >> low << low) | ((np.uint64(1) << low) - np.uint64(1) - place)
    anchor = ((np.uint64(1) << low) - np.uint64(1) - (sliding_min(packed_hash, min_len - k + 1) & ((np.uint64(1) << low) - np.uint64(1)))).astype(np.int64)
    long_enough = np.diff(offsets) >= min_len
    begin, end = offsets[:-1][long_enough], offsets[1:][long_enough] - min_len + 1
    if not len(begin):
        return None
    mark = np.zeros(n + 1, np.int32)
    mark[begin] += 1
    mark[end] -= 1
    inside = np.cumsum(mark[:-1]) > 0
    first = inside.copy()
    first[1:] &= anchor[1:] != anchor[:-1]
    first[begin] = True
    first = np.flatnonzero(first)
    row = np.searchsorted(offsets, first, "right") - 1
    last = np.append(first[1:], n) - 1
    last = np.minimum(last, offsets[row + 1] - min_len)
    a = anchor[first]
    kind = mix(roll.ranges(first, last + min_len) ^ ((a - first) * 65_536 + (last - first)).astype(np.uint64))
    return row, a, first, last, roll.ranges(a, a + k), kind


def _find_anchors(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            for i, j in chunks(offsets):
                found = _anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_len)
                if found is None:
                    continue
                row, a, first, last, gram, kind = found
                order = np.lexsort((a, kind, gram, row))  # a text's anchors of one kind are one row
                row, a, first, last, gram, kind = (x[order] for x in (row, a, first, last, gram, kind))
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (kind[1:] != kind[:-1])
                heads = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)).astype(np.int32)), pa.array((a - offsets[row + i] + offsets[i]).astype(np.int32)))
                before, after = (a - first)[heads].astype(np.int32), (last - a)[heads].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[heads].view(np.int64)), pa.array(kind[heads].view(np.int64)), batch.column("_key").take(pa.array(row[heads] + i)), pa.array(before), pa.array(after), places],
                    ["gram", "kind", "key", "before", "after", "places"],
                )

    return run


def _cut_contexts(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            wanted = batch.column("wanted")
            inner = wanted.flatten()
            text = np.repeat(np.arange(len(batch)), np.asarray(wanted.value_lengths().fill_null(0)))
            gram, kind, a, first, last = (np.asarray(inner.field(i)) for i in range(5))
            for i in range(0, len(inner), 20_000):
                cut = slice(i, i + 20_000)
                base = offsets[text[cut]]
                begin, end = base + first[cut], base + last[cut] + min_len
                # One byte more on the left, so that left extensions can be told apart; none where the text begins.
                left = np.where(first[cut] > 0, data[np.maximum(begin - 1, 0)].astype(np.int16), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[cut]), pa.array(kind[cut]), pa.array((first - a)[cut]), pa.array(left.astype(np.int32)), pa.array([data[x:y].tobytes() for x, y in zip(begin, end, strict=True)], pa.binary())],
                    ["gram", "kind", "rel", "left", "context"],
                )

    return run


def interval_tree(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Stack scan of a suffix array: (length, first, last) of every interval of common prefix ``least`` or more whose left neighbours differ.

    lcp[i] is the common prefix of suffixes i and i + 1; left[i] the byte before suffix i, or a negative number where there is none.
    """
    n = len(left)
    differs = np.zeros(n + 1, np.int64)
    differs[2:] = np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0))
    strong = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate([[False], strong, [False]]).astype(np.int8)))
    for run, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        stack: list[tuple[int, int]] = []
        for i, height in enumerate([*lcp[run:stop].tolist(), 0], run):
            begin = i
            while stack and stack[-1][0] > height:
                top, begin = stack.pop()
                if differs[i + 1] - differs[begin + 1] or left[begin] < 0:
                    yield top, begin, i
            if height and (not stack or stack[-1][0] < height):
                stack.append((height, begin))


def suffix_array(contexts: list[bytes], bucket: np.ndarray, rel: np.ndarray, left: np.ndarray, min_len: int):
    """Sorted suffixes of the owned windows of some buckets' contexts: context, start in it, left byte, and common prefixes with the next.

    Suffixes of different buckets never share a prefix here.
    """
    sizes = np.array([len(c) for c in contexts])
    counts = sizes - min_len + 1
    of = np.repeat(np.arange(len(contexts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    width = int(sizes.max())
    flat = np.frombuffer(b"".join(contexts) + bytes(width), np.uint8)
    at = (np.cumsum(sizes) - sizes)[of] + start
    rest = sizes[of] - start
    table = np.lib.stride_tricks.sliding_window_view(flat, width)[at]
    table[np.arange(width) >= rest[:, None]] = 0
    order = np.lexsort((table.view(f"S{width}").ravel(), bucket[of]))
    table, of, start, rest = table[order], of[order], start[order], rest[order]
    before = np.where(start > 0, flat[np.maximum((np.cumsum(sizes) - sizes)[of] + start - 1, 0)].astype(np.int32), left[of])
    # The window to the left belongs to another anchor: no interval here covers it, so the scan must report from this start on.
    before = np.where(start > 0, before, -1)
    unequal = table[1:] != table[:-1]
    lcp = np.where(unequal.any(axis=1), unequal.argmax(axis=1), width)
    lcp = np.minimum(lcp, np.minimum(rest[1:], rest[:-1]))
    lcp[bucket[of][1:] != bucket[of][:-1]] = 0
    return of, start, before, lcp


def _by_bucket(solve, min_len: int):
    """A function on batches that hands solve the rows of whole buckets, some _SUFFIXES suffixes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and size >= _SUFFIXES:  # whole buckets only
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4]) - min_len + 1
                last = row[0]
        if rows:
            yield solve(rows)

    return run


def _scan_buckets(min_len: int):
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        gram, kind, rel, left, contexts = zip(*rows, strict=True)
        _, bucket = np.unique(np.array(gram), return_inverse=True)
        of, start, before, lcp = suffix_array(list(contexts), bucket, np.array(rel), np.array(left), min_len)
        best = np.zeros(len(of), np.int64)
        for height, i, j in interval_tree(lcp, before, min_len):
            np.maximum(best[i : j + 1], height, out=best[i : j + 1])
        hit = np.flatnonzero(best)
        of, begin, end = of[hit], start[hit], (start + best)[hit]
        order = np.lexsort((begin, of))
        of, begin, end = of[order], begin[order], end[order]
        reach = np.maximum.accumulate(end + of * (1 << 32)) - of * (1 << 32)  # spans of one context that meet are one
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (begin[1:] > reach[:-1])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(of)) - 1
        of, begin, end = of[heads], begin[heads], reach[tails] if len(heads) else reach
        rel = np.array(rel)
        return pa.RecordBatch.from_arrays([pa.array(np.array(gram)[of]), pa.array(np.array(kind)[of]), pa.array((rel[of] + begin).astype(np.int32)), pa.array((rel[of] + end).astype(np.int32))], ["gram", "kind", "from", "to"])

    return _by_bucket(solve, min_len)


def _scan_groups(min_len: int):
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        gram, kind, rel, left, contexts, many = zip(*rows, strict=True)
        gram, kind, rel, many = np.array(gram), np.array(kind), np.array(rel), np.array(many)
        _, bucket = np.unique(gram, return_inverse=True)
        of, start, before, lcp = suffix_array(list(contexts), bucket, rel, np.array(left), min_len)
        rest = np.array([len(c) for c in contexts])[of] - start
        beside = np.maximum(np.append(lcp, 0), np.insert(lcp, 0, 0))
        # A whole context that several texts have is a repeat too, unless it is in an interval of its length.
        alone = np.flatnonzero((start == 0) & many[of] & (beside < rest))
        found = [*interval_tree(lcp, before, min_len), *zip(rest[alone].tolist(), alone.tolist(), alone.tolist(), strict=True)]
        height, first, last = np.array(found, np.int64).reshape(-1, 3).T
        name = [int.from_bytes(md5(contexts[of[i]][start[i] : start[i] + n]).digest()[:8], "big", signed=True) for n, i in zip(height.tolist(), first.tolist(), strict=True)]
        size = last - first + 1
        member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)
        at = (rel[of] + start)[member].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(gram[of][member]), pa.array(kind[of][member]), pa.array(np.repeat(np.array(name, np.int64), size)), pa.array(np.repeat(height, size)), pa.array(at)], ["gram", "kind", "group", "n_bytes", "at"])

    return _by_bucket(solve, min_len)


def _hash_windows(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, kind, rel, _, context, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                window = Rolling(np.frombuffer(context, np.uint8)).grams(min_len)
                n = len(window)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, gram)), pa.array(np.full(n, kind)), pa.array(np.arange(rel, rel + n, dtype=np.int32)), pa.array(window.view(np.int64)), pa.array(np.full(n, many))], ["gram", "kind", "at", "window", "many"])

    return run


def _hash_blocks(min_len: int, size: int, before: int):
    """Blocks of ``size`` windows, aligned by the anchor, within those of ``before`` windows that are named (null: all there are).

    inner is the hash of the bytes that all windows of a block have; outer of those they cover, null if the context has not all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, begin, inner, outer, whole = [], [], [], [], []
            for i, (rel, context, blocks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rel", "context", "blocks")), strict=True)):
                last = rel + len(context) - min_len
                if blocks is None:
                    at = np.arange(rel // size * size, last + 1, size)
                else:
                    at = (np.array(blocks)[:, None] + np.arange(0, before, size)).ravel()
                    at = at[(at + size > rel) & (at <= last)]
                roll = Rolling(np.frombuffer(context, np.uint8))
                full = (at >= rel) & (at + size - 1 <= last)
                here = np.where(full, at, rel) - rel
                of.append(np.full(len(at), i))
                begin.append(at)
                inner.append(roll.ranges(at - rel + size - 1, at - rel + min_len))
                outer.append(roll.ranges(here, np.where(full, here + size - 1 + min_len, here)))
                whole.append(full)
            if of:
                of, begin, inner, outer, whole = (np.concatenate(x) for x in (of, begin, inner, outer, whole))
                made = [pa.array(begin.astype(np.int32)), pa.array(inner.view(np.int64)), pa.array(outer.view(np.int64), mask=~whole)]
                yield pa.RecordBatch.from_arrays([batch.column("gram").take(pa.array(of)), batch.column("kind").take(pa.array(of)), *made], ["gram", "kind", "at", "inner", "outer"])

    return run


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("_text"))
        kept, removed, runs = [], [], []
        for i, found in enumerate(batch.column("found").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            merged: list[list[int]] = []
            for s in sorted({(a + e["from"], a + e["to"]) for f in found or () for a in f["places"] for e in f["ends"]}):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            at, parts = 0, []
            for s, e in merged:
                parts.append(text[at:s])
                at = e
            kept.append(b"".join(parts) + text[at:])
            removed.append(len(text) - len(kept[-1]))
            runs.append(len(merged))
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_text"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["_row", "_text", "n_bytes", "n_removed", "n_spans", "kept"])


def _kinds(texts: DataFrame, min_len: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchors whose k-gram repeats, one row for a text's anchors of one kind; the kinds under mixed k-grams; a context of each, with its bucket's number of kinds n."""
    anchors = stage(texts.mapInArrow(_find_anchors(min_len), "gram long, kind long, key binary, before int, after int, places array<int>"))
    size = F.size("places")
    grams = stage(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("places"), (F.min("kind") != F.max("kind")).alias("mixed")).where("places > 1").select("gram", "n", "mixed"))
    repeated = join_hot(anchors, grams, ["gram"]).groupBy("gram", "kind", "key", "mixed")
    repeated = stage(repeated.agg(F.first("before").alias("before"), F.first("after").alias("after"), F.first("places").alias("places"), F.count(F.lit(1)).alias("copies")))

    one = F.min(F.struct("key", F.get("places", F.lit(0)).alias("a"), "before", "after"))
    kinds = stage(repeated.where("mixed").groupBy("gram", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(size * F.col("copies")).alias("of_kind"), one.alias("one")))
    wanted = F.struct("gram", "kind", "one.a", (F.col("one.a") - F.col("one.before")).alias("first"), (F.col("one.a") + F.col("one.after")).alias("last"))
    wanted = kinds.select("one.key", wanted.alias("w")).groupBy("key").agg(F.collect_list("w").alias("wanted"))
    contexts = texts.join(wanted, F.col("_key") == F.col("key")).select("_text", "wanted").mapInArrow(_cut_contexts(min_len), "gram long, kind long, rel int, left int, context binary")
    contexts = stage(contexts.groupBy("gram", "kind").agg(F.first("rel").alias("rel"), F.first("left").alias("left"), F.first("context").alias("context")))
    crowd = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return repeated, kinds, join_hot(contexts, stage(crowd), ["gram"])


def _counted(crowded: DataFrame, min_len: int) -> DataFrame:
    """(gram, kind, at, window): windows that several kinds of one bucket have at the same place from the anchor on, or one that is marked many."""
    windows = stage(crowded.mapInArrow(_hash_windows(min_len), "gram long, kind long, at int, window long, many boolean"))
    again = stage(windows.groupBy("gram", "at", "window").agg(F.count(F.lit(1)).alias("n"), F.bool_or("many").alias("many")).where("n > 1 or many").drop("many"))
    return join_hot(windows, again, ["gram", "at", "window"])


def _counted_spans(crowded: DataFrame, min_len: int) -> DataFrame:
    """(gram, kind, from, to): ranges of the windows that several kinds of one bucket have at the same place from the anchor on."""
    crowded = stage(crowded)
    if crowded.isEmpty():
        return crowded.select("gram", "kind", F.col("rel").alias("from"), F.col("rel").alias("to"))
    again = lambda rows, key: stage(rows.groupBy("gram", "at", key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    named, before, spans = crowded.select("*", F.lit(None).cast("array<int>").alias("blocks")), 0, []
    for size in (s for s in BLOCKS if s <= min_len):
        blocks = stage(named.select("gram", "kind", "rel", "context", "blocks").mapInArrow(_hash_blocks(min_len, size, before), "gram long, kind long, at int, inner long, outer long"))
        found = join_hot(blocks, again(blocks, "inner"), ["gram", "at", "inner"]).drop("n")
        if size > 1:
            some = stage(found)
            found = stage(join_hot(some, again(some.where("outer is not null"), "outer"), ["gram", "at", "outer"]).drop("n"))
            # Of the kinds whose whole block repeats one goes on, as others may share some of its windows only.
            one = found.groupBy("gram", "at", "outer").agg(F.min("kind").alias("kind"))
            rest = some.join(found.select("gram", "kind", "at"), ["gram", "kind", "at"], "left_anti").select("gram", "kind", "at").unionByName(one.select("gram", "kind", "at"))
            named, before = crowded.join(rest.groupBy("gram", "kind").agg(F.collect_list("at").alias("blocks")), ["gram", "kind"]), size
        spans.append(found.select("gram", "kind", F.col("at").alias("from"), (F.col("at") + (size - 1 + min_len)).alias("to")))
    return reduce(DataFrame.unionByName, spans)


def repeat_spans(texts: DataFrame, min_len: int = MIN_LEN, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(key, places, ends): byte ranges of each text that windows of min_len bytes starting elsewhere too cover; texts has _key and _text.

    From each place on, the ranges are those of ends (from, to; they may begin before the place). One set of rows for equal texts
    (they have one key). Ranges may overlap.
    """
    repeated, kinds, contexts = _kinds(texts, min_len)
    all_of = lambda before, after: F.array(F.struct((-F.col(before)).alias("from"), (F.col(after) + min_len).alias("to")))
    whole = repeated.where("not mixed").select("key", "places", all_of("before", "after").alias("ends"))

    small = contexts.where(F.col("n") <= bucket_limit).select(*_CONTEXT)
    scanned = small.repartition("gram").sortWithinPartitions("gram").mapInArrow(_scan_buckets(min_len), "gram long, kind long, from int, to int")
    counted = _counted_spans(contexts.where(F.col("n") > bucket_limit).select(*_CONTEXT), min_len)
    ends = scanned.unionByName(counted).groupBy("gram", "kind").agg(F.collect_list(F.struct("from", "to")).alias("ends"))

    # Of each kind what repeats, from its anchor on: all of it if several anchors have it, else what the scan has found.
    decided = kinds.join(ends, ["gram", "kind"], "left").select("gram", "kind", "n", F.when(F.col("of_kind") > 1, all_of("one.before", "one.after")).otherwise(F.col("ends")).alias("ends")).where("ends is not null")
    return whole.unionByName(join_hot(repeated.where("mixed"), stage(decided), ["gram", "kind"]).select("key", "places", "ends"))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(group, n_bytes, id_col, start): each maximal repeat of min_len bytes or more with all its occurrences, a row for each.

    A group is a byte string, n_bytes long, that begins at byte start of each of its rows, and nowhere else in docs. It is maximal
    within its anchor's context, the windows that one anchor owns (up to about twice min_len bytes): a longer repeat is a chain of
    groups in which the next begins one byte after the last window of the one before. Strings that other strings with the same
    occurrences contain aren't groups. In a bucket of more than bucket_limit kinds each group is a single window.

    Rows that are copies of each other, repeated ids included, are different occurrences (rows of one id repeat then). Null and
    empty texts, and an empty table, have no groups. Very long texts are one row's work. Columns but the two named are ignored.
    """
    rows = packed(docs.select(id_col, text_col), text_col).withColumn("_key", F.unhex(F.md5(F.coalesce("_text", F.lit("")))))
    repeated, kinds, contexts = _kinds(rows.select("_key", "_text"), min_len)
    group = lambda name, n_bytes, at: F.struct(F.expr(name).alias("group"), F.expr(n_bytes).cast("bigint").alias("n_bytes"), F.expr(at).cast("int").alias("at"))
    whole = repeated.where("not mixed").select("key", "places", F.array(group("kind", f"before + after + {min_len}", "-before")).alias("groups"))

    contexts = contexts.join(kinds.select("gram", "kind", (F.col("of_kind") > 1).alias("many")), ["gram", "kind"])
    small = contexts.where(F.col("n") <= bucket_limit).select(*_CONTEXT, "many")
    scanned = small.repartition("gram").sortWithinPartitions("gram").mapInArrow(_scan_groups(min_len), "gram long, kind long, group long, n_bytes long, at int")
    counted = _counted(contexts.where(F.col("n") > bucket_limit).select(*_CONTEXT, "many"), min_len).select("gram", "kind", group("xxhash64(gram, at, window)", str(min_len), "at").alias("g"))
    found = scanned.select("gram", "kind", group("group", "n_bytes", "at").alias("g")).unionByName(counted)
    groups = found.groupBy("gram", "kind").agg(F.collect_list("g").alias("groups")).join(kinds.select("gram", "kind", "n"), ["gram", "kind"])
    members = join_hot(repeated.where("mixed"), stage(groups), ["gram", "kind"]).select("key", "places", "groups")

    members = whole.unionByName(members).groupBy("key").agg(F.collect_list(F.struct("places", "groups")).alias("found"))
    each = rows.join(members, F.col("_key") == F.col("key")).select(F.col(f"_row.{id_col}").alias(id_col), F.explode("found").alias("f"))
    each = each.select(id_col, F.col("f.places").alias("places"), F.explode("f.groups").alias("g")).select(id_col, "g", F.explode("places").alias("place"))
    return each.select("g.group", "g.n_bytes", id_col, (F.col("place") + F.col("g.at")).cast("bigint").alias("start"))


def remove_repeats(docs: DataFrame, text_col: str = "text", min_len: int = MIN_LEN, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary): each byte that a repeated string of min_len bytes covers is removed.

    All occurrences go, as judged on the input; matches never cross texts. Null text counts as empty: 0 bytes, nothing
    removed. Rows that are copies of each other, repeated ids included, count as different places. An empty table gives an
    empty result. Columns of docs are kept; any named as one of the four made here is replaced.
    """
    made = {"n_bytes", "n_removed", "n_spans", "kept"}
    rows = packed(docs, text_col).withColumn("_key", F.unhex(F.md5(F.coalesce("_text", F.lit("")))))
    spans = repeat_spans(rows.select("_key", "_text"), min_len, bucket_limit)
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("places", "ends")).alias("found"))
    joined = rows.join(spans, F.col("_key") == F.col("key"), "left").select("_row", "_text", "found")
    schema = f"_row {joined.schema['_row'].dataType.simpleString()}, _text string, n_bytes long, n_removed long, n_spans long, kept binary"
    out = joined.mapInArrow(_drop, schema)
    return out.select(*unpacked(docs.columns, text_col, made), "n_bytes", "n_removed", "n_spans", "kept")
