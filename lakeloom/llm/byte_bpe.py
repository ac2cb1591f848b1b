"""Byte-level BPE with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace: one small displacement for each bucket of
keys, one slot for each key) answers whole pre-tokens that are vocabulary entries. Tier two: any other pre-token is
a doubly linked list of byte pieces, and a heap of mergeable neighbours by (rank, position) merges the lowest first.
Results of both tiers are kept in a table of at most twice ``MEMO`` pre-tokens a task, none of them longer than
``MEMO_CHARS``; the half not asked for lately is forgotten.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import slices

MEMO, MEMO_CHARS = 200_000, 64
_BUCKET_KEYS = 3


def read_ranks(spark: SparkSession | None, path: str) -> list[bytes]:
    """Token bytes by id, from lines of base64 and rank. Ids are 0..n-1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: key -> its place in the list, or -1 for any other string."""

    def __init__(self, keys: list[bytes]) -> None:
        self.keys, self.buckets, self.seed = keys, max(1, len(keys) // _BUCKET_KEYS), 0
        while not self._built():
            self.seed += 1

    def _built(self) -> bool:
        n = len(self.keys)
        groups: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(self.keys):
            h = xxhash.xxh3_64_intdigest(key, self.seed)
            groups[h % self.buckets].append((h >> 34, (h & 0x3FFFFFFF) | 1, i))
        self.displace, self.slot = [0] * self.buckets, [-1] * n
        ones = []
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if len(group) == 1:
                ones.append(b)
                continue
            for d in range(8 * n + 64 if group else 0):
                at = [(x + d * y) % n for x, y, _ in group]
                if all(self.slot[k] < 0 for k in at) and len(set(at)) == len(at):
                    for k, (_, _, i) in zip(at, group, strict=True):
                        self.slot[k] = i
                    self.displace[b] = d
                    break
            else:
                if group:
                    return False  # another seed
        left = [k for k in range(n) if self.slot[k] < 0]
        for b, k in zip(ones, left, strict=True):  # a bucket of one key names its slot
            self.slot[k], self.displace[b] = groups[b][0][2], -k - 1
        return True

    def find(self, key: bytes) -> int:
        if not self.keys:
            return -1
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        d = self.displace[h % self.buckets]
        i = self.slot[-d - 1 if d < 0 else ((h >> 34) + d * ((h & 0x3FFFFFFF) | 1)) % len(self.keys)]
        return i if self.keys[i] == key else -1


class Encoder(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokens: list[bytes], pattern: str, whole: PerfectHash | None = None, memo: int = MEMO) -> None:
        super().__init__()
        self.tokens, self.memo, self.older = tokens, memo, {}
        self.whole = whole or PerfectHash(tokens)
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.pattern = regex.compile(pattern)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.memo:
            self.older = dict(self)
            self.clear()
        if (out := self.older.get(word)) is not None:
            self[word] = out
            return out
        raw = word.encode("utf-8", "surrogatepass")
        i = self.whole.find(raw)
        ids = [i] if i >= 0 else self._merged(raw)
        out = np.array(ids, dtype="<u4").tobytes()
        if len(word) <= MEMO_CHARS:
            self[word] = out
        return out

    def _merged(self, raw: bytes) -> list[int]:
        ranks, n = self.ranks, len(raw)
        if n == 1:
            return [ranks[raw]]
        get, push, pop = ranks.get, heapq.heappush, heapq.heappop
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[int] = []  # rank, start and end of a mergeable pair in one number
        for i in range(n - 1):
            if (r := get(raw[i : i + 2])) is not None:
                heap.append((r << 64) | (i << 32) | (i + 2))
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            i, stop = (x >> 32) & 0xFFFFFFFF, x & 0xFFFFFFFF
            j = after[i]
            if not end[i] or j >= n or end[j] != stop:
                continue  # one of the two has changed since
            k = after[j]
            end[i], end[j], after[i] = stop, 0, k
            if k < n:
                before[k] = i
                if (r := get(raw[i : end[k]])) is not None:
                    push(heap, (r << 64) | (i << 32) | end[k])
            h = before[i]
            if h >= 0 and (r := get(raw[h:stop])) is not None:
                push(heap, (r << 64) | (h << 32) | stop)
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def _worker_encoder(key: str, build) -> Encoder:
    return build()


class _Build:
    """Makes the task's encoder from what the driver has built; equal for equal vocabularies."""

    def __init__(self, shared, pattern: str) -> None:
        self.shared, self.pattern = shared, pattern

    def __call__(self) -> Encoder:
        whole = self.shared.value
        return Encoder(whole.keys, self.pattern, whole)

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Build)


def _encode(batches: Iterator[pa.RecordBatch], key: str, build: _Build, decode: bool) -> Iterator[pa.RecordBatch]:
    encoder = _worker_encoder(key, build)
    for b in slices(batches, "text"):
        ids = [encoder.encode(t or "") for t in b.column("text").to_pylist()]
        columns = [b.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        names = ["id", "n_tokens", "ids"]
        if decode:
            columns.append(pa.array([encoder.decode(x) for x in ids], pa.binary()))
            names.append("decoded")
        yield pa.RecordBatch.from_arrays(columns, names)


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids) for each row of ``docs``, and with ``decode`` the bytes that the ids stand for.

    ids: little-endian unsigned 32-bit integers, each match of ``pattern`` encoded by itself with the vocabulary in
    the file ``ranks``. A null or empty text has no ids. Null ids and repeated rows stay as they are; an empty table
    gives an empty result; other columns are not read. The vocabulary, of a fixed size, is sent to tasks once."""
    spark = docs.sparkSession
    whole = PerfectHash(read_ranks(spark, ranks))
    key = f"{xxhash.xxh3_64_hexdigest(b''.join(whole.keys))}:{pattern}"
    build = _Build(spark.sparkContext.broadcast(whole), pattern)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids binary" + ", decoded binary" * decode
    out = source.mapInArrow(lambda batches: _encode(batches, key, build, decode), schema)
    return out.withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, ranks: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes that the ids stand for."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(encoded.sparkSession, ranks))

    @F.pandas_udf("binary")
    def decoded(ids):
        return ids.map(lambda x: None if x is None else b"".join(map(tokens.value.__getitem__, np.frombuffer(x, dtype="<u4").tolist())))

    return encoded.withColumn("decoded", decoded(ids_col))
