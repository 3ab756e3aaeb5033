"""Each text operator against brute force on a small table with nulls, empty and repeated rows, ties and clashing columns."""

import base64
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftmerge.functions.staging import shared_dir
from driftmerge.llm import chaining, lattice, pieces, quality, queries, sharding, toxicity, webp
from driftmerge.llm.components import components
from driftmerge.llm.decontaminate import Index, decontaminate, hashed_words
from driftmerge.llm.media import as_media, media_digest, read_media, stored_all
from driftmerge.llm.near_dedup import near_duplicates, shingle_sets
from driftmerge.llm.suffix_dedup import remove_repeats, repeat_groups
from tests.compare import SF, assert_same

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "doc_id long, text string, kept string, score string, spans string, _row string, shard int, key string"


def corpus() -> list[str | None]:
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["the", "on", "Er", "é", "ing", "a", "st"]) for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long = text(120), text(3000)
    near = shared.split()
    near[60] = "changed"
    return [None, "", "   ", "one", "a b c", shared, shared, " ".join(near), text(40) + " " + shared, text(80), long, long + " tail", "x" * 900, "ab" * 600, "same same " * 200, "Ünï\n\tcode " * 30, text(200), "\0\x01 odd"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", "s", "p", "r", 5, "y") for i, t in enumerate(corpus())]
    rows.append(rows[5])  # a row that is repeated as a whole
    return spark.createDataFrame(rows, CLASHING).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOW))


def test_remove_repeats(docs, empty):
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    for least in (400, 7):
        seen = Counter(t[i : i + least] for _, t in texts for i in range(len(t) - least + 1))
        expected = Counter()
        for doc, t in texts:
            gone = np.zeros(len(t) + 1, bool)
            for i in range(len(t) - least + 1):
                if seen[t[i : i + least]] > 1:
                    gone[i : i + least] = True
            runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
            expected[doc, len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone, strict=False) if not g)] += 1
        for limit in (512, 2):  # small buckets are scanned, large ones counted
            got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs, min_len=least, bucket_limit=limit).collect())
            assert got == expected, (least, limit)
    assert remove_repeats(empty).count() == 0


def test_remove_repeats_in_a_crowd(spark):
    """Hundreds of near copies in one bucket, cut short and changed in places of their own or in common ones, against brute force."""
    rng = random.Random(3)
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(240))
    texts = []
    for i in range(240):
        t = bytearray(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(240)] = 48 + rng.choice((i % 7, rng.randrange(70)))
        texts.append(bytes(t[rng.randrange(30) : 240 - rng.randrange(30)]))
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    for least in (100, 33):
        seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
        gone = [{k for i in range(len(t) - least + 1) if seen[t[i : i + least]] > 1 for k in range(i, i + least)} for t in texts]
        expected = {i: bytes(b for k, b in enumerate(t) if k not in gone[i]) for i, t in enumerate(texts)}
        for limit in (10_000, 8):
            assert {r.doc_id: bytes(r.kept) for r in remove_repeats(docs, min_len=least, bucket_limit=limit).collect()} == expected, (least, limit)


def test_op1_goes_by_bytes_not_by_words(spark, tmp_path):
    """Of passages of 57 words that two documents have, one of 400 bytes is removed and one of 399 stays, however many words it has."""
    passage = lambda c, n: " ".join(f"{c}{i:05d}" for i in range(58))[:n]
    long, short = passage("l", 400), passage("s", 399)
    texts = [f"{long}1", f"2{long}3", f"{short}4", f"5{short}6", None, f"7{long[1:]}8"]
    kept = ["1", "23", texts[2], texts[3], "", texts[5]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r)[:5] for r in queries.op1_suffix_array_dedup(spark, str(tmp_path)).collect()}
    sizes = [len(t or "") for t in texts]
    assert got == {(i, n, n - len(k), int(n > len(k)), hashlib.sha256(k.encode()).hexdigest()) for i, (n, k) in enumerate(zip(sizes, kept, strict=True))}


def test_repeat_groups(docs, empty):
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    for least, limit in ((400, 512), (400, 2), (30, 512)):
        covered: dict[int, set[int]] = {}
        seen = Counter(t[i : i + least] for _, t in texts for i in range(len(t) - least + 1))
        for doc, t in texts:
            covered[doc] = {k for i in range(len(t) - least + 1) if seen[t[i : i + least]] > 1 for k in range(i, i + least)}
        text_of, groups = dict(texts), {}
        for r in repeat_groups(docs, min_len=least, bucket_limit=limit).collect():
            groups.setdefault((r.group, r.n_bytes), Counter())[r.doc_id, r.start] += 1
        strings = set()
        for (_, n), places in groups.items():
            doc, start = next(iter(places))
            string = text_of[doc][start : start + n]
            assert len(string) == n >= least and string not in strings
            strings.add(string)
            everywhere = Counter()  # repeated rows are occurrences of their own
            for doc, t in texts:
                start = t.find(string)
                while start >= 0:
                    everywhere[doc, start] += 1
                    start = t.find(string, start + 1)
            assert places == everywhere and sum(places.values()) > 1, (least, limit)
        for doc, expected in covered.items():
            got = {k for (_, n), places in groups.items() for d, start in places if d == doc for k in range(start, start + n)}
            assert got == expected, (least, limit, doc)
    assert repeat_groups(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [("a", " ".join(words(rows[5])[10:40])), ("b", "one"), ("c", None), ("d", ""), ("e", "no such words at all"), ("a2", rows[10]), (None, "same same")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    for blocks in (1 << 25, 300):
        for r in decontaminate(docs, bench, block_bytes=blocks).collect():
            w = words(r.text, pattern)
            hit, found = set(), set()
            for item, text in items:
                v = words(text, pattern)
                k = min(13, len(v))
                for j in range(len(v) - k + 1) if v else ():
                    for i in range(len(w) - k + 1):
                        if w[i : i + k] == v[j : j + k]:
                            hit |= set(range(i, i + k))
                            found.add(item or "")
            assert (r.n_words, r.n_hit, r.items, r.contaminated) == (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and r.kept == "k"
    assert decontaminate(empty, bench).count() == 0 and decontaminate(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontaminate_repeated_words(spark):
    rng = random.Random(5)
    run = lambda n, w="spam": [w] * n
    text = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    head, tail = text(9), text(9)
    rows = [run(300), head + run(40), run(60) + tail, text(20) + run(200) + text(20), run(25) + ["x"] + run(25), run(14), run(12), (["a", "b"] * 60)]
    items = [run(50), head + run(30) + tail, run(13), run(90) + ["x"], ["b", "a"] * 30, run(12) + text(5)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(str(i), " ".join(t)) for i, t in enumerate(items)], "item_id string, text string")
    for r in decontaminate(table, bench).collect():
        w, hit, found = rows[r.doc_id], set(), set()
        for i, v in enumerate(items):
            windows = {tuple(v[j : j + 13]) for j in range(len(v) - 12)}
            for k in range(len(w) - 12):
                if tuple(w[k : k + 13]) in windows:
                    hit |= set(range(k, k + 13))
                    found.add(str(i))
        assert (r.n_hit, r.items) == (len(hit), sorted(found)), r.doc_id
    index = Index(["x"], [" ".join(run(5000))], 13, 8)
    word_hash, first = hashed_words(np.frombuffer(" ".join(run(5000)).encode(), np.uint8), np.array([0, 5 * 5000 - 1]))
    assert len(index.hits(word_hash, first)[0]) < 5000  # not all places with all places


def test_near_duplicates(docs, empty):
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in texts.items()}
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for r in near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert near_duplicates(docs).count() == docs.count() and near_duplicates(empty).count() == 0


def test_shingle_sets_take_little_memory():
    """Hashing many texts makes arrays for a part of them at a time; the sets are the same however they are cut."""
    text = ("the quick brown fox jumps over " * 40).encode()
    data, offsets = np.frombuffer(text * 2000, np.uint8), np.arange(2001) * len(text)
    next(shingle_sets(data, offsets))
    tracemalloc.start()
    sets = [len(s) for s in shingle_sets(data, offsets)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(sets) == {6} and peak < 20e6


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "u long, v long")
    assert {r.node: r.root for r in components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_shards(spark, docs, empty):
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"))
    for rows, key in ((docs.drop("text"), "doc_id"), (many, "doc_id"), (many.withColumn("doc_id", F.lit(None).cast("long")), "doc_id")):
        out = sharding.sharded(rows, key, 7).collect()
        slots: dict[int, list[int]] = {}
        for r in out:
            slots.setdefault(r.shard, []).append(r.slot)
        assert len(out) == rows.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(i, [])) for i in range(7)]
        assert max(sizes) - min(sizes) <= 1
    assert sharding.sharded(empty.drop("text"), "doc_id").count() == 0
    before, after = ({r.doc_id: r.shard for r in sharding.sharded(many, "doc_id", n, slack=0.25).collect()} for n in (8, 9))
    assert sum(before[d] != after[d] for d in before) < 350  # a ninth at best, all but a ninth by modulo
    assert max(Counter(before.values()).values()) <= math.ceil(1000 * 1.25 / 8)


def test_allocation_is_the_walk_row_by_row():
    rng = random.Random(2)
    for _ in range(50):
        points = sharding.ring(4, 3)
        arcs = [rng.randint(0, 6) for _ in points]
        room = sharding.capacities(sum(arcs), points, 4, rng.choice([0.0, 0.5]))
        plan = sharding.allocation(arcs, points, room)
        placed = Counter()
        for _, a, b, shard, _ in plan:
            placed[shard] += b - a
        assert sum(placed.values()) == sum(arcs) and all(placed[s] <= room[s] for s in range(4))
        # Every row by itself: as many as there is room for stay at a point, those that came the shorter way first.
        left, slots, expected = list(room), Counter(), set()
        waiting = [(arc, x, arc) for arc, n in enumerate(arcs) for x in range(n)]
        while waiting:
            rest = []
            for arc, x, at in sorted(waiting, key=lambda w: (w[2], (w[2] - w[0]) % len(points), w[1])):
                shard = points[at][1]
                if left[shard]:
                    left[shard] -= 1
                    expected.add((arc, x, shard, slots[shard]))
                    slots[shard] += 1
                else:
                    rest.append((arc, x, at))
            waiting = [(arc, x, (at + next(i for i in range(1, len(points) + 1) if left[points[(at + i) % len(points)][1]])) % len(points)) for arc, x, at in rest]
        assert {(arc, x, shard, base + x - f) for arc, f, t, shard, base in plan for x in range(f, t)} == expected
        for arc, n in enumerate(arcs):
            assert sorted(x for a, f, t, *_ in plan if a == arc for x in range(f, t)) == list(range(n))


def test_webp_streams():
    # A known file of one transparent pixel, and own ones with every transform.
    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[[0, 0, 0, 0]]]
    rng = np.random.default_rng(4)
    for n in range(60):
        h, w, shift = (int(x) for x in (rng.integers(1, 40), rng.integers(1, 40), rng.integers(2, 6)))
        pixels = rng.integers(0, int(rng.choice([2, 5, 17, 256])), (h, w, 4)).astype(np.uint8)
        if n % 3 == 0:
            pixels = np.cumsum(pixels % 3, axis=1).astype(np.uint8)
        blocks = -(-h >> shift), -(-w >> shift)
        how = {"palette": n % 2 == 0, "cache_bits": int(rng.integers(0, 12)), "references": n % 4 < 2, "subtract_green": n % 5 == 0, "shift": shift}
        how |= {"modes": rng.integers(0, 14, blocks).astype(np.uint8)} if n % 3 else {}
        how |= {"factors": rng.integers(0, 256, (*blocks, 3)).astype(np.uint8)} if n % 4 else {}
        made = webp.encode(pixels, **how)
        assert np.array_equal(webp.decode(made), pixels), how
        with pytest.raises(webp.WebPError):
            webp.decode(made[: len(made) // 2])
    # Together, as one by one: with references, palettes, groups of long and short pictures, and cache indexes.
    many = []
    for n in range(90):
        text = rng.choice(np.frombuffer(b"aaeiou rstn,.", np.uint8), (int(rng.integers(1, 9)) if n else 90, 64, 3))
        pixels = np.full((*text.shape[:2], 4), 255, np.uint8)
        pixels[..., :3] = text
        if n % 4 == 0:
            pixels[len(pixels) // 2 :] = 32
        many.append(webp.encode(pixels, palette=n % 3 > 0, cache_bits=5 * (n % 7 == 0)))
    assert all(np.array_equal(a, webp.decode(m)) for a, m in zip(webp.decode_all(many), many, strict=True))
    with pytest.raises(webp.WebPError):
        webp.decode_all([*many, many[0][: len(many[0]) // 2]])
    for broken in (b"", b"RIFF\4\0\0\0WEBP", b"x" * 40):
        with pytest.raises(webp.WebPError):
            webp.decode(broken)


def test_media(docs, empty):
    for r in media_digest(docs).collect():
        raw = (corpus()[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    for r in read_media(as_media(docs)).collect():
        assert len(r.pixels) == r.width * r.height * 4 and r.kept == "k"
    long = webp.pictures(as_media.__globals__["stored"](bytes(192 * 5000)))
    assert len(long) == 2 and media_digest(empty).count() == 0


def test_media_take_the_transforms_that_pay():
    """Stored payloads use each part of the format where it pays, and come back; a picture's bytes don't depend on its batch."""
    rng = np.random.default_rng(9)
    y, x = np.mgrid[:80, :64]
    green = rng.integers(0, 256, (80, 64))
    smooth = (2 * x + 3 * y)[..., None] + rng.integers(0, 3, (80, 64, 3))
    tinted = np.cumsum(rng.integers(-3, 4, (80, 64)), 1) + 100
    made = {
        "smooth": smooth,
        "grey": green[..., None] + rng.integers(0, 3, (80, 64, 3)),
        "tinted": np.stack([2 * tinted - 60, tinted, 255 - tinted], -1) + 9 * y[..., None],
        "few": rng.integers(0, 256, (200, 3))[rng.integers(0, 200, (80, 64))],
        "noise": rng.integers(0, 256, (80, 64, 3)),
    }
    payloads = {k: (v & 255).astype(np.uint8).tobytes() for k, v in made.items()}
    payloads["text"] = "".join(rng.choice(["th", "ed", "in", "er", "an", "re", "on", "st", "sh", "ly", " the ", " of ", " ", ". "], 6000)).encode()[:7680]
    payloads["twice"] = payloads["noise"][:3840] * 2
    files = dict(zip(payloads, stored_all(list(payloads.values())), strict=True))
    read = {k: webp.Picture(f) for k, f in files.items()}
    kinds = {k: {kind for kind, *_ in p.undo} for k, p in read.items()}
    assert webp.PREDICTOR in kinds["smooth"] and kinds["grey"] == {webp.SUBTRACT_GREEN} and kinds["few"] == {webp.PALETTE}
    assert {webp.PREDICTOR, webp.CROSS_COLOUR} <= kinds["tinted"]
    assert read["text"].stream.cache_bits > 0
    assert len(files["twice"]) < 0.6 * len(files["noise"]) and len(files["smooth"]) < 0.4 * len(payloads["smooth"])
    for k, f in files.items():
        assert stored_all([payloads[k]]) == [f]
        assert webp.decode(f)[..., :3].tobytes() == payloads[k]
    together = [files[k] for k in files] * 8
    assert all(p[..., :3].tobytes() == payloads[k] for p, k in zip(webp.decode_all(together), list(files) * 8, strict=True))


def test_toxicity(spark, docs, empty):
    rng = random.Random(8)
    say = lambda bad: " ".join(rng.choice(["plain", "words", "here", "and", "there", "nothing", "else"]) + rng.choice(["", "s", "ed"]) for _ in range(60)) + (" nastyword vileterm" if bad else "")
    rows = [(i, say(i % 3 == 0), int(i % 3 == 0)) for i in range(240)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(table.where("doc_id < 160").drop("toxic"), table.select("doc_id", "toxic"))
    found = toxicity.toxicity(table.where("doc_id >= 160"), model).collect()
    assert sum(r.predicted == r.toxic for r in found) >= 0.95 * len(found) and all(0 <= r.score <= 1 for r in found)
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == docs.count() and len({r.score for r in got if r.doc_id < 3}) == 1
    assert toxicity.toxicity(empty, toxicity.learn(empty.select("doc_id", "text"), table.select("doc_id", "toxic"))).count() == 0


def test_held_out_labels(spark):
    """Toxicity and quality on the labelled documents of a table."""
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    table = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").join(labels, "doc_id")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.learn(table.where(~out), labels.where(~out))
    rows = toxicity.toxicity(table.where(out), model).collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    judged = quality.judged(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")).select("doc_id", "kept").join(labels, "doc_id").collect()
    kept = [sum(r.kept for r in judged if r.quality == q) / sum(r.quality == q for r in judged) for q in (0, 1)]
    print(f"toxic: AUC {auc:.3f}, right {right:.3f} of {len(rows)}; kept of bad {kept[0]:.3f}, of good {kept[1]:.3f}")
    assert auc > 0.92 and right > 0.95 and kept[0] < 0.05 and kept[1] > 0.99


def test_toxicity_keeps_the_share_of_labels(spark, monkeypatch):
    rng = random.Random(9)
    say = lambda odd: " ".join(rng.choice(["plain", "words", "here", "and", "there", "nothing", "else"]) for _ in range(40)) + (" maybeterm" if odd else "")
    rows = [(i, say(i % 10 == 0 or i % 4 == 1), int(i % 10 == 0)) for i in range(800)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", (80, 160))
    found = toxicity.toxicity(table, toxicity.learn(table.drop("toxic"), table.select("doc_id", "toxic"))).collect()
    assert not any(r.predicted for r in found)  # three of ten texts with the word are toxic
    assert sum(r.score for r in found) / len(found) == pytest.approx(0.1, abs=0.04)


def test_lattice(spark, docs, empty):
    model = lattice.learn(docs.where("doc_id % 2 = 0"))
    train = Counter(w for r in docs.where("doc_id % 2 = 0").collect() for w in [*words(r.text), None])
    n, v = sum(train.values()), len(train)
    for r in lattice.scored(docs, model).collect():
        tokens = [*words(corpus()[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens)) and r.score < 0
    assert lattice.scored(empty, model).count() == 0 and lattice.scored(docs, lattice.learn(empty)).count() == docs.count()


def test_lattice_sums_over_all_segmentations():
    held = lattice.Pieces.load()
    names = [t.encode() for t in pieces.Vocabulary.load().pieces] + [bytes([b]) for b in range(256)]
    names = list(dict.fromkeys(names))
    ends = np.cumsum([len(t) for t in names])
    hashes = lattice.Rolling(np.frombuffer(b"".join(names), np.uint8)).ranges(ends - np.array([len(t) for t in names]), ends)
    log = dict(zip(names, held.log[np.searchsorted(held.hashes, hashes)].tolist(), strict=True))

    def every(word: bytes) -> tuple[float, Counter]:
        if not word:
            return 1.0, Counter()
        total, uses = 0.0, Counter()
        for k in range(1, len(word) + 1):
            if word[:k] in log:
                rest, inner = every(word[k:])
                p = math.exp(log[word[:k]])
                total += p * rest
                uses[word[:k]] += p * rest
                for piece, x in inner.items():
                    uses[piece] += p * x
        return total, uses

    texts = [b"the", b"ab", "é".encode(), b"x"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    grid = lattice.Lattice(held, *lattice.marked(data, ends - [len(t) for t in texts], ends))
    found, expected = grid.forward(), Counter()
    for t, x in zip(texts, found.tolist(), strict=True):
        total, uses = every(pieces.MARK.encode() + t)
        assert math.exp(x) == pytest.approx(total)
        for piece, u in uses.items():
            expected[piece] += 2 * u / total
    uses = grid.expected(np.full(len(texts), 2.0))
    order = {int(h): i for i, h in enumerate(held.hashes)}
    for piece, h in zip(names, hashes, strict=True):
        assert uses[order[int(h)]] == pytest.approx(expected[piece], abs=1e-9)


def test_lattice_finds_each_piece_without_searching_for_all_strings(spark, docs, monkeypatch):
    held = lattice.Pieces.load()
    names = [t.encode() for t in pieces.Vocabulary.load().pieces]
    data, ends = np.frombuffer(b"".join(names), np.uint8), np.cumsum([len(t) for t in names])
    starts = ends - np.array([len(t) for t in names])
    searched, real = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **y: (searched.append(np.size(v)) if a is held.hashes else None) or real(a, v, *x, **y))
    grid = lattice.Lattice(held, data, starts, ends)
    assert sum(searched) < len(data)
    hashes = lattice.Rolling(data).ranges(starts, ends)
    assert all(held.hashes[grid.edges[len(t)][a]] == h for t, a, h in zip(names, starts.tolist(), hashes, strict=True))
    some = docs.where("doc_id % 2 = 0")
    scores = []
    for head in (lattice.HEAD, 0):  # words that are all broadcast, or all joined
        monkeypatch.setattr(lattice, "HEAD", head)
        scores.append({r.doc_id: (r.n_known, r.base_score, r.score) for r in lattice.scored(docs, lattice.learn(some)).collect()})
    assert all(scores[1][k] == pytest.approx(v) for k, v in scores[0].items())


def test_pieces(spark, docs, empty, monkeypatch):
    vocabulary = pieces.Vocabulary.load()
    unit = re.compile(f"{pieces.MARK}*[^{pieces.MARK}]+|{pieces.MARK}+")
    split = lambda t: unit.findall(pieces.MARK + t.replace(" ", pieces.MARK)) if t else []

    def best(word: str) -> tuple[float, list[int]]:
        """Score and ids; of equal scores the longest last piece."""
        found = [(0.0, [])]
        for e in range(1, len(word) + 1):
            score, ids = found[e - 1]
            top = score + vocabulary.unknown, ids + [vocabulary.bytes[x] for x in word[e - 1].encode()]
            for b in range(e - 1, -1, -1):
                if word[b:e] in vocabulary.pieces:
                    i, s = vocabulary.pieces[word[b:e]]
                    if found[b][0] + s >= top[0]:
                        top = found[b][0] + s, found[b][1] + [i]
            found.append(top)
        return found[-1]

    for limit, size in ((pieces.REMEMBERED, 1 << 20), (1000, 64)):  # also with little memory and ids a few at a time
        monkeypatch.setattr(pieces, "REMEMBERED", limit)
        monkeypatch.setattr(pieces, "_IDS", size)
        held = type("Held", (), {"value": vocabulary})
        texts = [r.text for r in docs.collect()] + ["a b", "\u2581x \u2581\u2581", " lead and trail ", "x" * 5000 + " " * 300]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["_row", "_text"])
        encoded = [b for part in (batch, batch.slice(3)) for b in pieces._encode(held)(iter([part]))]
        rows = [r for b in encoded for r in b.to_pylist()]
        assert [r["_text"] for r in rows] == texts + texts[3:]
        for r in rows:
            parts = [best(w) for w in split(r["_text"] or "")]
            assert r["ids"] == [i for _, ids in parts for i in ids] and r["piece_score"] == pytest.approx(sum(s for s, _ in parts))
        lists = [pa.RecordBatch.from_arrays([b.column("_row"), b.column("ids")], ["_row", "_text"]) for b in encoded]
        back = [t for b in pieces._decode(held)(iter(lists)) for t in b.column("decoded").to_pylist()]
        assert back == [(t or "").replace(pieces.MARK, " ").removeprefix(" ") if pieces.MARK in (t or "") and t.startswith(pieces.MARK + " ") else (t or "").replace(pieces.MARK, " ") for t in texts + texts[3:]]
    for r in pieces.decode(pieces.encode(docs)).collect():
        assert r.decoded == (r.text or "")
    assert pieces.encode(empty).count() == 0
    odd = spark.createDataFrame([(1, [vocabulary.bytes[255]]), (2, None), (3, [])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.decoded for r in pieces.decode(odd).collect()} == {1: "\ufffd", 2: None, 3: ""}
    words = ["▁the", "▁then", "▁they", "▁the", "▁▁▁", "\U000e0001", "▁x\ny"]
    together = {w: (i, s) for w, i, s in pieces.segment(set(words), vocabulary)}
    assert all(next(pieces.segment([w], vocabulary))[1:] == together[w] for w in set(words))  # shared prefixes change nothing


def test_round_trip_takes_one_python_process(spark, docs):
    import corpus_pipeline

    there, back = pieces.round_trip(docs), pieces.decode(pieces.encode(docs))
    assert there.columns == back.columns and sorted(there.collect()) == sorted(back.collect())
    for out in (there, corpus_pipeline.piece_encoding(spark, docs, "")):
        assert out._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1


def test_quality(docs, empty):
    counts = Counter()
    rng = random.Random(1)
    for _ in range(3000):  # one of two kinds of junk, each seen by two detectors
        junk, votes = rng.random() < 0.2, [1] * len(quality.LABELLERS)
        for j in range(len(votes)):
            right = rng.random() < 0.9
            votes[j] = (0 if right else 1) if junk and j in (0, 5, 6) else (2 if right else 1) if j >= quality.DETECTORS else 1
        counts[sum(v * 3**j for j, v in enumerate(votes)), junk] += 1
    total = Counter()
    for (p, _), n in counts.items():
        total[p] += n
    good, _ = quality.posteriors(total)
    assert sum(n for (p, junk), n in counts.items() if (good[p] < 0.5) == junk) > 0.95 * 3000
    out = quality.judged(docs).collect()
    assert len(out) == docs.count() and all(r.kept for r in out if not (r.text or "").strip())
    assert quality.judged(empty).count() == 0


def test_fenwick_and_chains():
    rng = random.Random(6)
    tree, values = chaining.Fenwick(20), [(-math.inf, -1)] * 20
    for i in range(100):
        p, x = rng.randrange(20), (rng.random(), i)
        tree.put(p, x)
        values[p] = max(values[p], x)
        q = rng.randint(0, 20)
        assert tree.before(q) == max([(-math.inf, -1), *values[:q]])
    diagonal = [(i, i + 100) for i in range(0, 60, 3)]
    found = chaining.chains(diagonal + [(5, 900), (30, 2)])
    assert found[0] == diagonal
    assert chaining.common_subsequence([1, 2, 3, 4], [2, 9, 4, 1]) == 2 and chaining.common_subsequence([], [1]) == 0


def test_fuzzy_repeats(docs, empty):
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    where: dict[tuple, set] = {}
    for d, w in texts.items():
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i : i + 50]), set()).add(d)
    for r in chaining.fuzzy_repeats(docs).collect():
        w = texts[r.doc_id]
        exact = {k for i in range(len(w) - 49) if len(where[tuple(w[i : i + 50])]) > 1 for k in range(i, i + 50)}
        got = {k for s in r.spans for k in range(s.start, s.end)}
        assert exact <= got and r.n_repeated == len(got) and r.n_words == len(w), r.doc_id
    by_id = {r.doc_id: r for r in chaining.fuzzy_repeats(docs).collect()}
    assert by_id[7].n_repeated == 120 and by_id[9].n_repeated == 0  # one word changed; a text of its own
    assert chaining.fuzzy_repeats(empty).count() == 0


def repeats(spark, texts):
    """Words of each text that are in spans."""
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return {r.doc_id: {k for s in r.spans for k in range(s.start, s.end)} for r in chaining.fuzzy_repeats(table).collect()}


def test_fuzzy_repeats_leaves_no_tables_between_steps(spark, docs):
    """Of the tables that a run writes those are left that its lazy result reads: the texts and the passages of both rounds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = lambda: {str(s.getPath()) for s in fs.listStatus(path)} if fs.exists(path) else set()
    before = tables()
    out = chaining.fuzzy_repeats(docs)
    left = tables() - before
    assert len(left) == 3
    assert all("zstd" in str(f.getPath()) for x in left for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(x)) if "part-" in str(f.getPath()))
    assert out.count() == docs.count()


def test_fuzzy_repeats_beyond_the_hub(spark):
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = text(60)
    a, b = text(90) + shared + text(90), text(120) + shared + text(70)
    got = repeats(spark, [" ".join(t) for t in (a, b, text(8) + shared[:40] + text(7), text(9) + shared[20:] + text(6))])
    assert set(range(90, 150)) <= got[0] and set(range(120, 180)) <= got[1] and not got[2] and not got[3]


def test_fuzzy_repeats_in_families(spark):
    """Two long texts share a passage that shorter, or longer, texts quote parts of."""
    rng = random.Random(31)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, expected, families = [], [], 60
    for i in range(families):
        shared, outer = text(80), (12, 400)[i % 2]
        for _ in range(2):
            begin = rng.randint(60, 120)
            expected.append((len(rows), begin))
            rows.append(text(begin) + shared + text(90))
        for k in range(4):
            at = rng.randint(0, 56)
            rows.append(text(outer + k) + shared[at : at + 24] + text(outer))
    got = repeats(spark, [" ".join(t) for t in rows])
    recall = sum(len(got[i] & set(range(b, b + 80))) for i, b in expected) / (80 * len(expected))
    print(f"recall of words {recall:.3f}")
    assert recall == 1
    wrong = sum(len(got[i]) for i in range(len(rows))) - 80 * len(expected)
    assert wrong < 0.1 * 80 * len(expected)


def test_fuzzy_repeats_twice_in_the_shortest_text(spark):
    rng = random.Random(22)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = text(60)
    got = repeats(spark, [" ".join(t) for t in (shared + text(20) + shared, text(200) + shared + text(90), text(90) + shared + text(300))])
    assert {*range(60), *range(80, 140)} <= got[0] and set(range(200, 260)) <= got[1] and set(range(90, 150)) <= got[2]


@pytest.mark.parametrize(("every", "least"), [(5, 0.7), (8, 0.9), (10, 0.9)])
def test_fuzzy_repeats_recall(spark, every, least):
    rng = random.Random(every)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(100):
        shared = text(60)
        rows += [text(40) + shared + text(40), text(50) + [f"v{rng.randrange(10**6)}" if i % every == every - 1 else w for i, w in enumerate(shared)] + text(50)]
    got = repeats(spark, [" ".join(t) for t in rows])
    found = sum(len(got[2 * i]) >= 50 and len(got[2 * i + 1]) >= 50 for i in range(100))
    print(f"every {every}th word changed: {found} of 100 found")
    assert found >= 100 * least


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name])


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = corpus_pipeline.stage(f(spark, docs, SF))
        assert docs.count() <= before
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert docs.count() > 0 and docs.select("doc_id").distinct().count() == docs.count()
    nothing = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, f in corpus_pipeline.STAGES:
        nothing = f(spark, nothing, SF)
        assert nothing.count() == 0
