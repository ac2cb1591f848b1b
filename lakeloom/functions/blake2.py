"""BLAKE2b of texts, many at a time: each of the sixteen words of the state is a column of 64-bit integers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.ordering import with_hash_index

#: Fixed values of RFC 7693: the initial state, and which words of a block each round mixes in.
IV = [0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179]
SIGMA = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15],
    [14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3],
    [11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4],
    [7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8],
    [9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13],
    [2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9],
    [12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11],
    [13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10],
    [6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5],
    [10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0],
]
ROUNDS, BLOCK = 12, 128
#: The rows and diagonals that a round mixes: columns of the 4 x 4 state, then its diagonals.
_LANES = [(k, 4 + k, 8 + k, 12 + k) for k in range(4)] + [(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4) for k in range(4)]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(bits)) | (x << np.uint64(64 - bits))


def digests(messages: list[bytes], size: int) -> np.ndarray:
    """A row of ``size`` bytes for each message."""
    n = len(messages)
    lengths = np.array([len(m) for m in messages], dtype=np.int64)
    blocks = np.maximum(1, -(-lengths // BLOCK))
    # by number of blocks, so that those still at work are always the last rows
    order = np.argsort(blocks, kind="stable")
    h = np.empty((8, n), dtype=np.uint64)
    for k in range(8):
        h[k] = np.uint64(IV[k] ^ (0x01010000 ^ size if k == 0 else 0))
    ends = np.searchsorted(blocks[order], np.arange(1, int(blocks.max(initial=0)) + 1), "left")
    for b, at in enumerate(ends.tolist()):
        rows = order[at:]
        raw = b"".join(messages[r][BLOCK * b : BLOCK * (b + 1)].ljust(BLOCK, b"\0") for r in rows)
        m = np.frombuffer(raw, dtype="<u8").reshape(len(rows), 16).T.astype(np.uint64)
        v = [*h[:, rows], *(np.full(len(rows), x, dtype=np.uint64) for x in IV)]
        v[12] = v[12] ^ np.minimum(lengths[rows], BLOCK * (b + 1)).astype(np.uint64)
        v[14] = np.where(blocks[rows] == b + 1, ~v[14], v[14])
        for turn in range(ROUNDS):
            words = SIGMA[turn % 10]
            for lane, (i, j, k, q) in enumerate(_LANES):
                v[i] = v[i] + v[j] + m[words[2 * lane]]
                v[q] = _turned(v[q] ^ v[i], 32)
                v[k] = v[k] + v[q]
                v[j] = _turned(v[j] ^ v[k], 24)
                v[i] = v[i] + v[j] + m[words[2 * lane + 1]]
                v[q] = _turned(v[q] ^ v[i], 16)
                v[k] = v[k] + v[q]
                v[j] = _turned(v[j] ^ v[k], 63)
        for k in range(8):
            h[k, rows] ^= v[k] ^ v[k + 8]
    return np.ascontiguousarray(h.T).astype("<u8").view(np.uint8).reshape(n, 64)[:, :size]


def blake2b(message: Column, size: int = 64) -> Column:
    """The hexadecimal BLAKE2b digest of ``size`` bytes (1 to 64) of a text or binary column; null for null."""
    if not 1 <= size <= 64:
        raise ValueError("a digest has 1 to 64 bytes")

    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        some = texts.notna()
        own = [x.encode("utf-8", "replace") if isinstance(x, str) else bytes(x) for x in texts[some]]
        raw = digests(own, size).tobytes().hex()
        out = pd.Series([None] * len(texts), dtype=object, index=texts.index)
        out[some] = [raw[2 * size * k : 2 * size * (k + 1)] for k in range(len(own))]
        return out

    return hashed(message)


def random_key(seed: int, *parts: Column) -> Column:
    """The 128-bit key of a row in a seeded global order: the digest of seed and parts with a zero byte between them, as 32
    hexadecimal digits (nulls as empty texts)."""
    zero = F.lit("\u0000")
    columns = [F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)]
    return blake2b(F.concat(*[x for c in columns for x in (c, zero)][:-1]), 16)


def shuffled(df: DataFrame, seed: int, group: str, dataset: str, shard: str, key: str, name: str = "idx") -> DataFrame:
    """Adds random_key and the place in the order of (random_key, dataset, shard, key), shards by their base name. Ranges
    are the key's first digits, which rows fill evenly."""
    base = F.regexp_extract(F.col(shard), r"[^/]*$", 0)
    out = df.withColumn("random_key", random_key(seed, F.col(group), F.col(dataset), base, F.col(key))).withColumn("_base", base)
    return with_hash_index(out, "random_key", dataset, "_base", key, name=name).drop("_base")


def blake2b_share(value: Column, seed: int) -> Column:
    """A number in 0..1 from the 8-byte digest of ``seed:value``, its first 53 bits as a double has them."""
    digest = blake2b(F.concat(F.lit(f"{seed}:"), value.cast("string")), 8)
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(20,0)") for at in (1, 9))
    return (high * F.lit(1 << 32).cast("decimal(20,0)") + low).cast("double") / F.lit(float(2**64))


def stable_split(df: DataFrame, key: str, val: float, test: float, seed: int = 17, check: bool = True) -> DataFrame:
    """Adds split: val, test or train by a share of each key, which stays as the table grows. With ``check`` an empty split
    is an error, which takes a pass over the keys."""
    if val < 0 or test < 0 or val + test >= 1:
        raise ValueError("val and test must be at least 0 and less than 1 together")
    share = blake2b_share(F.col(key), seed)
    out = df.withColumn("_share", share)
    out = out.withColumn("split", F.when(F.col("_share") < val, "val").when(F.col("_share") < F.lit(val + test), "test").otherwise("train")).drop("_share")
    if check and out.select("split").distinct().count() < 3:
        raise ValueError("the split leaves train, val or test empty")
    return out
