"""Media columns: bytes kept as lossless pictures, and pictures read back as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.llm import webp
from driftmerge.llm.common import buffers, chunks, packed, unpacked

#: A row of a picture holds so many bytes: 64 pixels of three samples.
ROW_BYTES = 192
#: Bytes of pictures that are read together.
READ_BYTES = 4 << 20
#: Rows of one picture; longer payloads become a series of pictures.
PICTURE_ROWS = 4096


def stored_all(payloads: list[bytes]) -> list[bytes]:
    """Payloads, of a positive multiple of ROW_BYTES bytes each, as one picture or a series of them."""
    pictures, counts = [], []
    for payload in payloads:
        samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3)
        for at in range(0, len(samples), PICTURE_ROWS):
            part = samples[at : at + PICTURE_ROWS]
            pixels = np.full((*part.shape[:2], 4), 255, np.uint8)
            pixels[..., :3] = part
            pictures.append(pixels)
        counts.append(-(-len(samples) // PICTURE_ROWS))
    files: list[bytes] = []
    bounds = np.concatenate([[0], np.cumsum([p.size for p in pictures])])
    for i, j in chunks(bounds):
        files += webp.encode_all(pictures[i:j])
    made = iter(files)
    return [b"".join(next(made) for _ in range(n)) for n in counts]


def stored(payload: bytes) -> bytes:
    """One payload, as stored_all() has it."""
    return stored_all([payload])[0]


def pixel_arrays(media: list[bytes]) -> list[np.ndarray]:
    """height x width x 4 bytes (R, G, B, A) of each picture, or series of pictures of equal width, one below the other."""
    series = [webp.pictures(m) for m in media]
    pixels = iter(webp.decode_all([p for pictures in series for p in pictures]))
    return [np.concatenate([next(pixels) for _ in pictures]) for pictures in series]


def features(pixels: np.ndarray) -> str:
    """Size, mean of each colour in thousandths, distinct colours, and the most frequent of 64 grey levels."""
    height, width, _ = pixels.shape
    total = height * width
    means = [int(pixels[..., c].sum(dtype=np.int64)) * 1000 // total for c in range(3)]
    colours = len(np.unique(np.ascontiguousarray(pixels).view(np.uint32)))
    levels = np.bincount((pixels[..., :3].astype(np.int64).sum(-1) // 12).ravel(), minlength=64)
    return f"{width}x{height} mean={means[0]},{means[1]},{means[2]} colours={colours} level={int(levels.argmax())}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("_text"))
        for i, j in chunks(offsets):
            part = batch.slice(i, j - i)
            texts = [data[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
            payloads = [t + b" " * (-len(t) % ROW_BYTES if t else ROW_BYTES) for t in texts]
            distinct = list(dict.fromkeys(payloads))
            made = dict(zip(distinct, stored_all(distinct), strict=True))
            columns = pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in payloads], pa.int64()), pa.array([made[p] for p in payloads], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_text"), *columns], ["_row", "_text", "n_bytes", "payload_bytes", "media"])


def as_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_bytes, payload_bytes and media: the text's UTF-8 bytes, filled up with spaces, as lossless pictures.

    Null and empty texts become one row of spaces. Equal texts give equal media. Columns of docs that are named as one of the
    three are replaced; an empty table gives an empty result. A text of any length is one row's work and stays in its task.
    """
    rows = packed(docs, text_col)
    kind = rows.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(_store, f"_row {kind}, _text string, n_bytes long, payload_bytes long, media binary")
    return out.select(*unpacked(docs.columns, text_col, {"n_bytes", "payload_bytes", "media"}), "n_bytes", "payload_bytes", "media")


def _read(with_pixels: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column("_text"))
            for i, j in chunks(offsets, READ_BYTES):
                part = batch.slice(i, j - i)
                media = part.column("_text").to_pylist()
                distinct = list(dict.fromkeys(m for m in media if m is not None))
                seen: dict[bytes | None, tuple] = {None: (None,) * 7}
                for m, pixels in zip(distinct, pixel_arrays(distinct), strict=True):
                    payload = pixels[..., :3].tobytes()
                    seen[m] = (pixels.shape[1], pixels.shape[0], hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(m).hexdigest(), features(pixels), pixels.tobytes() if with_pixels else None)
                out = [seen[m] for m in media]
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("_row"), *columns[: 7 if with_pixels else 6]], ["_row", "width", "height", "payload_sha256", "tail_crc32", "media_sha256", "feature", *["pixels"] * with_pixels])

    return run


def read_media(rows: DataFrame, media_col: str = "media", with_pixels: bool = True) -> DataFrame:
    """rows, without the media column, with width, height, payload_sha256, tail_crc32, media_sha256 and feature, and pixels (R, G, B, A bytes by rows).

    The payload is the R, G and B samples. Null media give nulls; bytes that are no lossless picture raise WebPError in the job.
    Rows that repeat stay, with equal values; columns named as one made here are replaced; an empty table gives an empty result.
    """
    made = {"width", "height", "payload_sha256", "tail_crc32", "media_sha256", "feature", "pixels", media_col}
    held = packed(rows, media_col)
    kind = held.schema["_row"].dataType.simpleString()
    schema = f"_row {kind}, width int, height int, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string" + ", pixels binary" * with_pixels
    out = held.mapInArrow(_read(with_pixels), schema)
    return out.select(*unpacked(rows.columns, media_col, made), *(c for c in out.columns if c != "_row"))


def media_digest(docs: DataFrame) -> DataFrame:
    """For each of docs (doc_id, text): what was stored, and what the stored bytes give when they are read back."""
    kept = as_media(docs.select("doc_id", "text")).drop("text").withColumn("media_bytes", F.octet_length("media").cast("bigint"))
    found = read_media(kept, with_pixels=False)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
