"""Token ids of a corpus as files of frequency-ranked ids in byte-aligned variable-length code.

Ids are replaced by their rank by frequency in the whole corpus (ties by id), so that frequent ids take one byte. A
rank takes 1 to 4 little-endian bytes; its length less one is two bits of a control byte, four ranks to a control
byte, and all control bytes stand before all data bytes. A file holds documents in id order:

    8 bytes   magic "LLTOKEN1"
    u32, u32  documents, size of a null bitmap in bytes
    i64[]     ids (0 where null), then the bitmap
    u32[]     ranks by document
    u64, u64  control bytes, data bytes
    u8[]      control bytes, each document starting a new one
    u8[]      data bytes

``ranks.bin`` beside the files has "LLRANKS1" and the id of each rank (u32). Reading is table lookup: a control byte gives four
lengths, their running sum the places of the data bytes."""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import drop_saved, saved, shared_dir, slices

MAGIC, RANKS = b"LLTOKEN1", b"LLRANKS1"
#: Ids of a part, on average, at most: parts are as many as a shuffle has, or more where there are more ids.
PART_IDS = 50_000_000
#: A file is closed once it has so many bytes of ranks.
FILE_BYTES = 1 << 25
#: Ranks that a reader unpacks at once.
READ_IDS = 1_000_000
#: Words whose ids a task remembers: at most twice so many, of which the half not asked for lately is forgotten; longer
#: words are not remembered.
MEMO, MEMO_BYTES = 450_000, 64
#: Bytes of text worked on at once.
SLICE_CHARS = 4_000_000
#: Stands for null where ids are compared.
_NULL_ID = -(2**63)

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ALNUM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
_UPPER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
#: First byte of U+0300, the first character that can compose with a letter before it.
_COMPOSING = 0xCC
_PUNCTUATION = string.punctuation.encode()
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


# ---- encoding text -----------------------------------------------------------------------------------------------


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ..., counts[k] numbers for each k."""
    out = np.repeat(first - (np.cumsum(counts) - counts), counts)
    out += np.arange(len(out))
    return out


def _values(column: pa.Array) -> list[bytes]:
    """The values of a binary column; to_pylist() takes ten times as long for short ones."""
    if not len(column):
        return []
    _, ends, data = column.buffers()
    ends, data = np.frombuffer(ends, dtype=np.int32)[column.offset : column.offset + len(column) + 1].tolist(), bytes(data or b"")
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class WordEncoder:
    """Ids of texts by the tokenizers library, asked once for each distinct word.

    Pre-tokens of the vocabularies this is for never cross white space, and their normalizer works on each word by
    itself (``lower``: and lower-cases it), so a text's ids are those of its words. Texts that may hold a special
    token are given to the library whole. A-Z is lower-cased beforehand, so that fewer words are asked for, but not in
    words where a capital may compose with what follows: the library composes first, and some marks have no
    composed capital. A point or comma between an ASCII letter or digit and white space is a word of its own, and
    what else of ASCII punctuation ends a word is asked for apart from it: both are pre-tokens of their own."""

    def __init__(self, path: str, lower: bool = True, memo: int = MEMO, wide: str = "<u4") -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lower, self.memo, self.wide, self.known, self.older = lower, memo, np.dtype(wide), {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 1000):  # the library's results are large
            out += [np.array(e.ids, dtype=self.wide).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]
        return out

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """The same for words of letters only: each is one pre-token, so in a text of many its ids end where a token ends
        a word."""
        out = []
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype=self.wide)
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, ends = ids.tobytes(), (ends * self.wide.itemsize).tolist()
                out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                out += self._library([w.decode() for w in part])
        return out

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) > self.memo:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, words))
        fresh: dict[bytes, bytes] = {}
        letters, other, ends = set(), set(), []

        def ask(w: bytes) -> None:
            if (ids := known.get(w, older.get(w))) is not None:
                fresh[w] = ids
            elif w.isalpha() or (not w.isascii() and (word := w.decode("utf-8", "replace")).isalpha() and word.lower().isalpha()):
                letters.add(w)
            else:
                other.add(w)

        missing = [k for k, ids in enumerate(out) if ids is None]
        for k in missing:
            w = words[k]
            if (ids := older.get(w)) is not None:
                fresh[w] = ids
                continue
            stem = w.rstrip(_PUNCTUATION)
            # no letter but those below U+0250 is looked at, and none that is lower-cased to a letter and a mark
            if len(stem) < len(w) and stem and (_ALNUM[stem[-1]] or (0xC3 <= stem[-2:][0] <= 0xC8 and stem.decode("utf-8", "replace")[-1].lower().isalpha())):
                ends.append((w, stem))
                ask(stem)
                ask(w[len(stem) :])
            else:
                ask(w)
        for own, encode in ((list(letters), self._letters), (list(other), lambda own: self._library([w.decode("utf-8", "replace") for w in own]))):
            fresh.update(zip(own, encode(own), strict=True))
        for w, stem in ends:
            fresh[w] = fresh[stem] + fresh[w[len(stem) :]]
        for k in missing:
            out[k] = fresh[words[k]]
        known.update((w, ids) for w, ids in fresh.items() if len(w) <= MEMO_BYTES)
        return out

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids by text) of texts in UTF-8."""
        whole: dict[int, np.ndarray] = {}
        data = b"\n".join([*texts, b""])
        low = data.lower()
        if any(s in low for s in self.special):  # what is special only in small letters is not so here
            for k, t in enumerate(texts):
                if any(s in t.lower() for s in self.special):
                    whole[k] = np.frombuffer(self._library([t.decode("utf-8", "replace")])[0], dtype=self.wide)
            texts = [b"" if k in whole else t for k, t in enumerate(texts)]
            data = b"\n".join([*texts, b""])
            low = data.lower()
        raw = np.frombuffer(data, dtype=np.uint8)
        inside = ~_SPACE[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        mark = np.flatnonzero((raw == 46) | (raw == 44))
        mark = mark[(mark > 0) & ~inside[np.minimum(mark + 1, len(raw) - 1)]]
        begins[mark[_ALNUM[raw[mark - 1]]]] = True
        start = np.flatnonzero(begins)
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        bound = np.searchsorted(start, first)
        offsets = np.append(start, len(raw)).astype(np.int32)  # words with the white space after them
        used = np.frombuffer(low if self.lower else data, dtype=np.uint8)
        if self.lower and len(start):
            composing = np.flatnonzero((raw[1:] >= _COMPOSING) & _UPPER[raw[:-1]])
            if len(composing):
                flag = np.zeros(len(start), dtype=bool)
                flag[np.searchsorted(start, composing, side="right") - 1] = True
                used = used.copy()
                kept = np.concatenate([np.zeros(start[0], dtype=bool), np.repeat(flag, np.diff(offsets))])
                used[kept] = raw[kept]
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(used)]).dictionary_encode()
        at, of = coded.indices.to_numpy(), self._of_words([w.rstrip() for w in _values(coded.dictionary)])
        size = np.fromiter(map(len, of), dtype=np.int64, count=len(of)) // self.wide.itemsize
        begin, counts = np.cumsum(size) - size, size[at]
        ids = np.frombuffer(b"".join(of), dtype=self.wide)[_spread(begin[at], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])[bound]
        by_text = np.diff(total)
        if whole:
            ids = np.insert(ids, np.repeat(total[list(whole)], [len(x) for x in whole.values()]), np.concatenate(list(whole.values())))
            by_text[list(whole)] = [len(x) for x in whole.values()]
        return ids, by_text


@lru_cache(maxsize=2)
def _encoder(path: str, wide: str) -> WordEncoder:
    return WordEncoder(path, wide=wide)


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, wide: str) -> Iterator[pa.RecordBatch]:
    """Documents with their ids; last a row without ids, with how often the task has met each id."""
    encoder = _encoder(path, wide)
    total = np.zeros(len(encoder.final), dtype=np.int64)
    width = np.dtype(wide).itemsize
    names = ["id", "n", "sum", "ids", "met"]
    for b in slices(batches, "text", SLICE_CHARS):
        ids, counts = encoder(pc.fill_null(b.column("text").cast(pa.binary()), b"").to_pylist())
        if end_id is not None:
            ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
        seen = np.bincount(ids, minlength=len(total))
        if len(seen) > len(total):
            total = np.concatenate([total, np.zeros(len(seen) - len(total), dtype=np.int64)])
        total += seen
        ends = np.concatenate([[0], np.cumsum(counts) * width])
        view = memoryview(ids).cast("B")
        sums = [zlib.crc32(view[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), packed, pa.nulls(len(counts), pa.binary())], names)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for b in batches:
        for x in b.column("met"):
            c = np.frombuffer(x.as_buffer(), dtype="<i8")
            total, c = (np.concatenate([v, np.zeros(max(len(total), len(c)) - len(v), dtype=np.int64)]) for v in (total, c))
            total = total + c
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "n"])


# ---- the code ----------------------------------------------------------------------------------------------------


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(control bytes, data bytes) of each of consecutive documents with ``counts`` ranks each."""
    ranks = ranks.astype("<u4")
    length = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    groups = -(-counts // 4)
    shift = 4 * (np.cumsum(groups) - groups) - (np.cumsum(counts) - counts)
    code = np.zeros(4 * int(groups.sum()), dtype=np.uint8)
    code[np.arange(len(ranks)) + np.repeat(shift, counts)] = length - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[np.cumsum(counts)].tolist()
    c_ends = np.cumsum(groups).tolist()
    return [control[a:b] for a, b in zip([0, *c_ends], c_ends, strict=False)], [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of consecutive documents with ``counts`` ranks each."""
    length = _LENGTHS[control].reshape(-1)
    groups = -(-counts // 4)
    at = np.repeat(np.cumsum(groups * 4) - groups * 4, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    length = length[at]
    place = np.cumsum(length) - length
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
    out = padded[place].astype("<u4")
    for k in (1, 2, 3):
        longer = np.flatnonzero(length > k)
        if len(longer):
            out[longer] |= padded[place[longer] + k].astype("<u4") << np.uint32(8 * k)
    return out


def file_bytes(ids: list[int | None], counts: list[int], control: list[bytes], data: list[bytes]) -> bytes:
    bitmap = np.packbits([i is None for i in ids]).tobytes()
    c, d = b"".join(control), b"".join(data)
    head = MAGIC + struct.pack("<II", len(ids), len(bitmap)) + np.array([i or 0 for i in ids], dtype="<i8").tobytes() + bitmap
    return head + np.array(counts, dtype="<u4").tobytes() + struct.pack("<QQ", len(c), len(d)) + c + d


def read_file(content: bytes | memoryview) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, ranks by document, all ranks) of a file, of about READ_IDS ranks at once."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    n, bits = struct.unpack_from("<II", content, 8)
    at = 16
    ids = np.frombuffer(content, dtype="<i8", count=n, offset=at).tolist()
    at += 8 * n
    null = np.unpackbits(np.frombuffer(content, dtype=np.uint8, count=bits, offset=at), count=n)
    at += bits
    counts = np.frombuffer(content, dtype="<u4", count=n, offset=at).astype(np.int64)
    at += 4 * n
    c, d = struct.unpack_from("<QQ", content, at)
    control = np.frombuffer(content, dtype=np.uint8, count=c, offset=at + 16)
    data = np.frombuffer(content, dtype=np.uint8, count=d, offset=at + 16 + c)
    docs = [None if z else i for i, z in zip(ids, null, strict=True)]
    piece = (np.cumsum(counts) - counts) // READ_IDS
    cuts = (np.flatnonzero(np.diff(piece)) + 1).tolist()
    c_at, d_at = 0, 0
    for lo, hi in zip([0, *cuts], [*cuts, n], strict=True):
        own = counts[lo:hi]
        groups = int((-(-own // 4)).sum())
        code = control[c_at : c_at + groups]
        used = int(_LENGTHS[code].sum()) - int(((-own) % 4).sum())  # a group's empty places count as one byte each
        yield docs[lo:hi], own, unpack(code, data[d_at : d_at + used], own)
        c_at, d_at = c_at + groups, d_at + used


def put_file(uri: str, content: bytes) -> None:
    """Writes a whole file under another name and then renames it: a task that runs twice leaves one whole file."""
    import uuid

    system, path = fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    temporary = f"{folder}/_{uuid.uuid4().hex}.{name}"
    with system.open_output_stream(temporary) as out:
        out.write(content)
    system.move(temporary, path)


# ---- Spark jobs --------------------------------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch], rank_of, cuts: list[int], wide: str) -> Iterator[pa.RecordBatch]:
    """Parts are ranges of ids; an id that fills several is dealt to them by the checksum, in its order."""
    ranks, limits = rank_of.value, np.array(cuts, dtype=np.int64)
    for b in slices(batches, "ids"):
        counts = np.asarray(b.column("n"), dtype=np.int64)
        raw = np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype=wide)
        control, data = pack(ranks[raw], counts)
        ids, sums = pc.fill_null(b.column("id"), _NULL_ID).to_numpy(), b.column("sum").to_numpy()
        lo = np.searchsorted(limits, ids, side="left")
        part = lo + (np.maximum(np.searchsorted(limits, ids, side="right") - lo, 1) * sums >> 32)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column("id"), b.column("sum"), b.column("n"), pa.array(control, pa.binary()), pa.array(data, pa.binary())], ["part", "id", "sum", "n", "control", "data"])


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Files of the rows of one or more parts, which come one after the other and in order."""
    now, k = -1, 0
    rows: list[tuple] = []
    held = size = 0

    def close() -> pa.RecordBatch:
        nonlocal rows, held, size, k
        name = f"{now:06d}-{k:06d}.tok"
        put_file(f"{folder}/{name}", file_bytes(*map(list, zip(*rows, strict=True))))
        out = pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([name]), pa.array([held], pa.int64())], ["part", "file", "n"])
        rows, held, size, k = [], 0, 0, k + 1
        return out

    for b in batches:
        for part, *row in zip(*(b.column(c).to_pylist() for c in ("part", "id", "n", "control", "data")), strict=True):
            if rows and (part != now or size >= FILE_BYTES):
                yield close()
            if part != now:
                now, k = part, 0
            rows.append(tuple(row))
            held += row[1]
            size += len(row[2]) + len(row[3])
    if rows:
        yield close()


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 1 << 16) -> DataFrame:
    """Writes the ids of all texts to ``folder`` in ascending id order and returns (part, file, n, start) of each file.

    start: ids in all files before it, by name. Null texts are empty; null ids come first; rows that repeat an id
    follow each other, in order of their ids' checksums, then of their coded ids. An empty table writes no file. What
    the driver holds is the vocabulary's ranks and one number a part. A text is worked on whole: a task needs some 60
    bytes for each of its longest. Other columns are not read."""
    spark = docs.sparkSession
    wide = "<u2" if vocabulary <= 1 << 16 else "<u4"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tokens = source.mapInArrow(lambda batches: _tokens(batches, tokenizer, end_id, wide), "id long, n long, sum long, ids binary, met binary")
    tokens = saved(tokens, compression="zstd")
    counts = tokens.where("met is not null").select("met").mapInArrow(_added, "token long, n long")
    counts = counts.groupBy("token").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    by_rank = np.array([r.token for r in sorted(counts, key=lambda r: (-r.n, r.token))], dtype="<u4")
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype="<u4")
    rank_of[by_rank] = np.arange(len(by_rank))
    put_file(f"{folder}/ranks.bin", RANKS + by_rank.tobytes())
    shared = spark.sparkContext.broadcast(rank_of)
    # ids are cut into ranges once, from the ids alone: a range partitioner would run the coding twice
    tokens_only = tokens.where("met is null")
    ids = tokens_only.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ids // PART_IDS)
    cuts = tokens_only.select(F.percentile_approx(F.coalesce("id", F.lit(_NULL_ID)), [k / parts for k in range(1, parts)] or [0.5], max(10_000, 25 * parts))).first()[0] or []
    coded = "part int, id long, sum long, n long, control binary, data binary"
    packed = tokens_only.select("id", "sum", "n", "ids").mapInArrow(lambda batches: _packed(batches, shared, sorted(cuts), wide), coded)
    ordered = packed.repartition(parts, "part").sortWithinPartitions("part", "id", "sum", "n", "control", "data")
    files = saved(ordered.mapInArrow(lambda batches: _written(batches, folder), "part int, file string, n long"))
    drop_saved(tokens)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = files.groupBy("part").agg(F.sum("n").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))  # a row a part
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    out = files.join(of_part, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("base")
    out._saved_at = files._saved_at
    return out


def _read(batches: Iterator[pa.RecordBatch], by_rank, whole: bool) -> Iterator[pa.RecordBatch]:
    table = by_rank.value
    for b in batches:
        for content, start in zip(b.column("content"), b.column("start").to_pylist(), strict=True):
            for docs, counts, ranks in read_file(memoryview(content.as_buffer())):
                ids = memoryview(table[ranks].tobytes())
                end = np.cumsum(counts)
                parts = [ids[4 * (e - n) : 4 * e] for e, n in zip(end.tolist(), counts.tolist(), strict=True)]
                own = pa.array(parts, pa.binary()) if whole else pa.array(map(zlib.crc32, parts), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + end - counts, pa.int64()), pa.array(counts, pa.int64()), own], ["id", "start", "n_tokens", "ids" if whole else "ids_crc32"])
                start += int(counts.sum())


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, id_col: str = "doc_id", whole: bool = True) -> DataFrame:
    """(id_col, start, n_tokens, ids) for each document in the files of ``folder``; ids as little-endian u32. Without
    ``whole``, instead of ids ids_crc32, the unsigned crc32 of those bytes."""
    ranks = spark.read.format("binaryFile").load(f"{folder}/ranks.bin").select("content").first()[0]
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(ranks), dtype="<u4", offset=len(RANKS)))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    # one row a file of some MB of ids: small beside the contents, which stay where they are read
    starts = files.select("file", "start")
    schema = "id long, start long, n_tokens long, " + ("ids binary" if whole else "ids_crc32 long")
    return found.join(starts, "file").select("content", "start").mapInArrow(lambda batches: _read(batches, shared, whole), schema).withColumnRenamed("id", id_col)


def token_table(docs: DataFrame, tokenizer: str, end_id: int | None = None, folder: str | None = None, whole: bool = True, **how) -> DataFrame:
    """read_token_files() of what write_token_files() has written (an empty frame where no file was)."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    files = write_token_files(docs, tokenizer, folder, end_id, **how)
    return read_token_files(spark, folder, files, how.get("id_col", "doc_id"), whole)
