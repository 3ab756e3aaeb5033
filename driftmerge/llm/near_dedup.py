"""Near-duplicate groups by an inverted join on MinHash signature coordinates.

1. Each text becomes the set of its five-word shingles and a signature of N least hashes. Equal sets are one class from here on.
2. Classes are posted under each pair of coordinate and value. Pairs of classes that agree in T coordinates or more are sought:
   with the values of a class ordered from rare to frequent, two such classes share one among the first N - T + 1 of either
   (prefix filter), so frequent values are hardly ever posted, and values that occur once are skipped.
3. This is done twice: a short signature finds the classes that have T values in common with others at all, and these few are
   signed and posted again with a long one, whose T can be close to the threshold.
4. Under each posted value, members are first compared with one hub only. Components are formed, and only members that are in
   another component than the hub are then compared with all others, unless both have too many shingles to themselves.
5. Each candidate pair's agreeing coordinates are counted; pairs of T or more are confirmed on the full sets of both texts.

Two sets of similarity 0.75 agree in fewer than 20 of 48 or 160 of 256 coordinates with a probability of a few in a million; those
are the only links that can be lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.llm.common import LOWER, SMALL_CHUNK_BYTES, SPACED_WORDS, Rolling, buffers, chunks, releasing, shingle_hashes, stage, words
from driftmerge.llm.components import components

#: (N, T) of the short and of the long signature.
SHORT, LONG = (48, 20), (256, 160)
SHINGLE = 5
PERCENT = 75
#: Bytes of texts whose words are hashed at a time; the arrays made of them are some 24 times as large.
SET_BYTES = SMALL_CHUNK_BYTES
#: Pairs of 32 bytes; so many at most are broadcast.
BROADCAST_PAIRS = 100_000

_random = np.random.default_rng(7)
_XOR = _random.integers(0, 1 << 63, LONG[0], dtype=np.uint64)
_ODD = _random.integers(0, 1 << 63, LONG[0], dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j in chunks(offsets, SET_BYTES):
        lower = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = words(lower, offsets[i : j + 1] - offsets[i], SPACED_WORDS)
        word_hash = Rolling(lower).ranges(starts, ends)
        grams = shingle_hashes(word_hash, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(grams[a : b - SHINGLE + 1])
            else:
                yield shingle_hashes(word_hash[a:b], b - a) if b > a else grams[:0]


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    return ((((shingles ^ _XOR[:n, None]) * _ODD[:n, None]) >> np.uint64(32)).min(axis=1)).astype(np.uint32).view(np.int32)


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, count, sign = [], [], []
            for s in shingle_sets(*buffers(batch.column("_text"))):
                count.append(len(s))
                kind.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sign.append(signature(s, n) if len(s) else None)
            made = [pa.array(count, pa.int64()), pa.array(kind, pa.binary()), pa.array(sign, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_key")), *made], ["_id", "_key", "n_shingles", "kind", "sign"])

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = batch.column("kind")
        for i, s in enumerate(shingle_sets(*buffers(batch.column("_text")))):
            yield pa.RecordBatch.from_arrays([kinds.take(pa.array(np.full(len(s), i))), pa.array(s.view(np.int64))], ["kind", "shingle"])


def _sharing(involved: DataFrame, texts: DataFrame) -> DataFrame:
    """(kind, levels): how many shingles of each of the involved classes occur in 2 to 3, 4 to 7, 8 to 15 ... of them.

    Level by level two sets have no more in common than the lesser of their two numbers, which bounds their similarity. That is
    exact, and in a large group of texts that are just too far apart it is what keeps them from being compared all with all:
    what they have in common is frequent, and what is rare in the one is not in the other.
    """
    made = f"kind {dict(texts.dtypes)['kind']}, shingle long"
    posted = texts.join(involved, "kind", "left_semi").mapInArrow(releasing(_shingles), made)
    often = posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle", F.floor(F.log2("n")).cast("int").alias("level"))
    found = posted.join(often, "shingle").groupBy("kind", "level").agg(F.count(F.lit(1)).cast("int").alias("n"))
    counts = found.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("m"))
    return counts.select("kind", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("levels"))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for s, t in zip(shingle_sets(*buffers(batch.column("text_u"))), shingle_sets(*buffers(batch.column("text_v"))), strict=True):
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(s) + len(t) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])


def _agreeing(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """pairs (u, v) with the number of coordinates of the long signature in which they agree, T at least; sets whose sizes rule the link out are gone."""
    # A byte of each value is enough to compare by: values that differ agree in it once in 256 times, which only lets pairs pass.
    u, v = (kinds.select(F.col("kind").alias(x), F.transform("sign", lambda s: (s.bitwiseAND(255) - 128).cast("tinyint")).alias(f"sign_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in "uv")
    sizes = 100 * F.least("n_u", "n_v") >= PERCENT * F.greatest("n_u", "n_v")
    agree = F.size(F.filter(F.zip_with("sign_u", "sign_v", lambda a, b: a == b), lambda x: x))
    return pairs.join(u, "u").join(v, "v").select(*pairs.columns, agree.alias("agree"), sizes.alias("_sizes")).where("_sizes").drop("_sizes").where(F.col("agree") >= LONG[1])


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough. A few pairs are sent to the texts, many are joined by shuffles."""
    few = pairs.count() <= BROADCAST_PAIRS
    u, v = (texts.select(F.col("kind").alias(x), F.col("_text").alias(f"text_{x}")) for x in "uv")
    kind = dict(pairs.dtypes)["u"]
    if few:
        named = F.broadcast(pairs)
        half = u.join(named, "u").select("u", "v", "text_u")
        return v.join(half, "v").select("u", "v", "text_u", "text_v").mapInArrow(releasing(_confirm), f"u {kind}, v {kind}")
    return pairs.join(u, "u").join(v, "v").select("u", "v", "text_u", "text_v").mapInArrow(releasing(_confirm), f"u {kind}, v {kind}")


def _prefix(kinds: DataFrame, n: int, least: int) -> DataFrame:
    """Classes that have ``least`` values in common with others: kind, weight (how often others have them), the values to post."""
    posted = kinds.select("kind", F.explode(F.transform("sign", lambda x, i: F.xxhash64(i, x))).alias("at"))
    often = posted.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # The k values that others have too come last; values of one class alone take up the first n - k places.
    values = posted.join(often, "at").groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("n", "at"))).alias("values"))
    weight = F.aggregate("values", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    return values.where(F.size("values") >= least).select("kind", weight.alias("weight"), F.slice("values.at", F.lit(1), F.size("values") - (least - 1)).alias("values"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: the id, n_shingles, component_id (least id of its group) and kept (component_id = id).

    Texts of fewer than five words are one shingle; null, empty and blank texts have none, are alone in their groups and kept.
    Ids ought to be unique: rows that share the least id of a group are all kept. A null id never becomes a group's id unless
    all its ids are null; such rows count as kept. An empty table gives none.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).withColumn("_key", F.unhex(F.md5(F.coalesce("_text", F.lit("")))))
    id_type = dict(rows.dtypes)["_id"]
    signed = stage(rows.mapInArrow(releasing(_sign(SHORT[0])), f"_id {id_type}, _key binary, n_shingles long, kind binary, sign array<int>"))
    kinds = stage(signed.where("kind is not null").groupBy("kind").agg(F.min("_id").alias("least_id"), F.min("_key").alias("key"), F.first("sign").alias("sign")))

    near = _prefix(kinds, *SHORT).select("kind").join(kinds, "kind").select("kind", "key")
    texts = rows.groupBy("_key").agg(F.first("_text").alias("_text")).join(near, F.col("_key") == F.col("key")).select("kind", "_text")
    texts = stage(texts)
    members = stage(texts.select(F.lit(None).cast("int").alias("_id"), F.lit(None).cast("binary").alias("_key"), "_text").mapInArrow(releasing(_sign(LONG[0])), "_id int, _key binary, n_shingles long, kind binary, sign array<int>").drop("_id", "_key"))
    prefix = stage(_prefix(members, *LONG))
    posts = prefix.select("kind", "weight", F.explode("values").alias("at"))

    # First: each class with that one of the hubs it meets with which it agrees most. A value's hub is its member with the most
    # frequent values, the one in the middle of a group.
    hubs = posts.groupBy("at").agg(F.max(F.struct("weight", "kind")).alias("hub"))
    pairs = posts.join(hubs, "at").where("hub.kind != kind").select(F.greatest("hub.kind", "kind").alias("u"), F.least("hub.kind", "kind").alias("v"), "kind").distinct()
    tested = stage(_agreeing(pairs, members).groupBy("kind").agg(F.max_by(F.struct("u", "v"), F.struct("agree", "u", "v")).alias("x")).select("x.*").distinct())
    links = stage(_confirmed(tested, texts))

    # Second: the hub of each value with all members that aren't joined with it yet; third: those left with all other members.
    for left_only in (False, True):
        roots = prefix.join(components(links), F.col("kind") == F.col("node"), "left").select("kind", "weight", F.coalesce("root", "kind").alias("root"))
        rooted = posts.drop("weight").join(roots, "kind")
        hubs = rooted.groupBy("at").agg(F.max(F.struct("weight", "kind", "root")).alias("hub"), (F.min("root") != F.max("root")).alias("open")).where("open").select("at", "hub")
        rooted = rooted.join(hubs, "at")
        if left_only:
            rooted = stage(rooted.select("at", "kind", "root", (F.col("root") != F.col("hub.root")).alias("apart")))
            shared = _sharing(rooted.select("kind").distinct(), texts).join(members.select("kind", "n_shingles"), "kind")
            # What a class can have in common with any other is bound by what it shares at all.
            able = stage(shared.where(100 * F.aggregate("levels", F.lit(0), lambda t, x: t + x) >= PERCENT * F.col("n_shingles")).join(prefix.select("kind", "values"), "kind"))
            rooted = rooted.join(able, "kind")
            # A pair is made under the least value that both have posted, and nowhere else.
            mine, other = (x.select("at", *(F.col(c).alias(f"{c}_{n}") for c in ("kind", "root", "values", "levels", "n_shingles"))) for x, n in ((rooted.where("apart"), 1), (rooted, 2)))
            common = F.aggregate(F.zip_with("levels_1", "levels_2", lambda a, b: F.least(a, b)), F.lit(0), lambda t, x: t + x)
            close = 100 * common >= PERCENT * (F.col("n_shingles_1") + F.col("n_shingles_2") - common)
            meet = F.array_min(F.array_intersect("values_1", "values_2"))
            pairs = mine.join(other, (mine["at"] == other["at"]) & (F.col("root_1") != F.col("root_2")) & close & (meet == mine["at"])).select(F.greatest("kind_1", "kind_2").alias("u"), F.least("kind_1", "kind_2").alias("v"))
        else:
            pairs = rooted.where("root != hub.root").select(F.greatest("hub.kind", "kind").alias("u"), F.least("hub.kind", "kind").alias("v"))
        fresh = stage(_agreeing(pairs.distinct().join(tested, ["u", "v"], "left_anti"), members).select("u", "v"))
        tested = tested.unionByName(fresh)
        links = stage(links.unionByName(_confirmed(fresh, texts)))

    group = kinds.join(components(links), F.col("kind") == F.col("node"), "left").select("kind", F.coalesce("root", "kind").alias("root"), "least_id")
    group = group.join(group.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("kind", "component_id")
    out = signed.drop("sign", "_key").join(group, "kind", "left")
    component = F.when(F.col("kind").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
