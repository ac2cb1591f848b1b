"""Media columns: byte payloads stored as lossless WebP images, read back as pixel arrays with features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import saved, slices
from lakeloom.llm.webp import ROWS, WIDTH, decode_strips, encode_strips, webp_file, webp_images

#: Bytes of text whose images a task makes at once.
SLICE = 6_000_000


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with bytes 0 up to a positive multiple of WIDTH, and the length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def to_webp(payloads: list[bytes]) -> list[bytes]:
    """A WebP file of each payload: rows of WIDTH grey samples, ROWS rows to a strip."""
    strips, counts = [], []
    for p in payloads:
        rows = np.frombuffer(p, dtype=np.uint8).reshape(-1, WIDTH)
        own = [rows[k : k + ROWS] for k in range(0, len(rows), ROWS)]
        strips += own
        counts.append([len(o) for o in own])
    coded, at, out = encode_strips(strips) if strips else [], 0, []
    for own in counts:
        out.append(webp_file([(WIDTH, h, coded[at + k]) for k, h in enumerate(own)]))
        at += len(own)
    return out


def from_webp(files: list[bytes]) -> list[np.ndarray]:
    """The pixel array (rows x WIDTH grey samples) of each file."""
    images = [webp_images(f) for f in files]
    strips, at, out = decode_strips([i for own in images for i in own]), 0, []
    for own in images:
        out.append(np.concatenate(strips[at : at + len(own)]))
        at += len(own)
    return out


def pixel_feature(pixels: np.ndarray) -> str:
    """Size, sum, distinct samples, and places where a sample differs from its left neighbour."""
    turns = int((pixels[:, 1:] != pixels[:, :-1]).sum())
    return f"{pixels.shape[1]}x{pixels.shape[0]} sum={int(pixels.sum(dtype=np.int64))} distinct={len(np.flatnonzero(np.bincount(pixels.reshape(-1), minlength=256)))} turns={turns}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", SLICE):
        own = [padded(t) for t in b.column("text").to_pylist()]
        media = to_webp([p for p, _ in own])
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([n for _, n in own], pa.int64()), pa.array(media, pa.binary())], ["row", "n_bytes", "media"])


def store_media(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Writes (row, n_bytes, media) for each row of ``docs`` as Parquet, in ``path`` or the shared folder, and reads it.

    row: the columns ``keep`` (all but the text, if none are named). media: a WebP file of the text's UTF-8 bytes,
    filled up with bytes 0 to a positive multiple of WIDTH. A null or empty text is one row of zeros. Equal texts have
    equal files; an empty table gives an empty one."""
    source = docs.select(F.struct(*(keep or [c for c in docs.columns if c != text_col])).alias("row"), F.col(text_col).cast("string").alias("text"))
    row = source.schema["row"].dataType.simpleString()
    return saved(source.mapInArrow(_stored, f"row {row}, n_bytes long, media binary"), path)


def _read(batches: Iterator[pa.RecordBatch], pixels: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "media", SLICE // 2):
        files = b.column("media").to_pylist()
        arrays = from_webp(files)
        payloads = [a.tobytes() for a in arrays]
        columns = [
            b.column("row"),
            b.column("n_bytes"),
            pa.array([len(p) for p in payloads], pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
            pa.array([zlib.crc32(p[-WIDTH:]) for p in payloads], pa.int64()),
            pa.array([len(f) for f in files], pa.int64()),
            pa.array([hashlib.sha256(f).hexdigest() for f in files]),
            pa.array([pixel_feature(a) for a in arrays]),
        ]
        names = ["row", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        if pixels:
            columns.append(pa.array(payloads, pa.binary()))
            names.append("pixels")
        yield pa.RecordBatch.from_arrays(columns, names)


def read_media(stored: DataFrame, pixels: bool = True) -> DataFrame:
    """(row, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored media,
    decoded from their files, and with ``pixels`` the samples themselves, row by row."""
    row = stored.schema["row"].dataType.simpleString()
    schema = f"row {row}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pixels binary" * pixels
    return stored.mapInArrow(lambda batches: _read(batches, pixels), schema)
