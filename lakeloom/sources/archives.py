"""Archives in parts, nested archives, key-set filters, members by locator; shards by bytes and groups, with an index."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a tar block, and of an archive that one task reads members of.
BLOCK, RUN_BYTES = 512, 1 << 28


class _Parts(io.RawIOBase):
    """The bytes of several files, one after the other, or a window of them; files are opened as they are read."""

    def __init__(self, uris: list[str], start: int = 0, size: int | None = None) -> None:
        self.files, self.first, self.open, self.at = [], [], {}, 0
        end = 0
        for uri in uris:
            system, path = fs.FileSystem.from_uri(uri)
            self.files.append((system, path))
            self.first.append(end)
            end += system.get_file_info(path).size
        self.start, self.size = start, end - start if size is None else size
        self.first.append(end)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence])
        return self.at

    def readinto(self, buffer) -> int:
        at, left = self.start + self.at, min(len(buffer), self.size - self.at)
        if left <= 0:
            return 0
        k = bisect.bisect_right(self.first, at) - 1
        if k not in self.open:
            system, path = self.files[k]
            self.open = {k: system.open_input_file(path)}
        self.open[k].seek(at - self.first[k])
        data = self.open[k].read(min(left, self.first[k + 1] - at))
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def archive_groups(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(archive, parts): the files of each archive under ``path``; ``x.partaa``, ``x.partab``, … are the archive x, in
    order of their names, and any other file is an archive by itself."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    return files.groupBy(F.regexp_replace("path", r"\.part[a-z]{2}$", "").alias("archive")).agg(F.array_sort(F.collect_list("path")).alias("parts"))  # one archive's files


TARS = (".tar", ".tar.gz", ".tgz")
_INDEX = "archive string, parts array<string>, window struct<start:long,size:long>, packed boolean, place long, path string, start long, size long"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files that the headers of archives name. Contents are jumped over, but in packed archives, which are read."""
    window = pa.struct([("start", pa.int64()), ("size", pa.int64())])
    for b in batches:
        for archive, parts, own, head in zip(*(b.column(c).to_pylist() for c in ("archive", "parts", "window", "head")), strict=True):
            raw = _Parts(parts, *(() if own is None else (own["start"], own["size"])))
            packed = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            from_ = 0 if own is None else own["start"]
            rows = []
            with tarfile.open(fileobj=io.BufferedReader(raw, 1 << 16), mode="r:gz" if packed else "r:") as tar:
                for m in tar:
                    if m.isfile():
                        rows.append((from_ + (min(m.offset, raw.size - 1) if packed else m.offset), head + m.name, m.offset_data + (0 if packed else from_), m.size))
                    tar.members = []  # it would hold all
                    if len(rows) == 4096:
                        yield _index_batch(archive, parts, own, packed, rows, window)
                        rows = []
            if rows:
                yield _index_batch(archive, parts, own, packed, rows, window)


def _index_batch(archive: str, parts: list[str], own: dict | None, packed: bool, rows: list[tuple], window: pa.DataType) -> pa.RecordBatch:
    place, path, start, size = zip(*rows, strict=True)
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([archive] * n), pa.array([parts] * n, pa.list_(pa.string())), pa.array([own] * n, window), pa.array([packed] * n), pa.array(place, pa.int64()), pa.array(path, pa.string()), pa.array(start, pa.int64()), pa.array(size, pa.int64())],
        ["archive", "parts", "window", "packed", "place", "path", "start", "size"],
    )


def member_index(archives: DataFrame, inner: DataFrame | None = None, depth: int = 1) -> DataFrame:
    """(archive, parts, window, packed, place, path, start, size): where each file in archives (archive, parts) lies.

    Only headers are read, unless an archive is packed. inner: names of members (its column ``path``, and ``archive``, if
    it has that) that are tar files and to be opened too, to the depth given; all others stay closed. Their files are
    named ``inner.tar/name`` and lie in the ``window`` of the archive's bytes that the inner one takes. place: the byte at
    which a member begins, which grows in the order of members. An inner archive of a packed one cannot be opened."""
    many = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    none = F.lit(None).cast("struct<start:long,size:long>")
    rows = archives.select("archive", "parts", none.alias("window"), F.lit("").alias("head"))
    out = level = rows.repartition(many, "archive").mapInArrow(_indexed, _INDEX)
    for _ in range(depth if inner is not None else 0):
        tars = level.where(~F.col("packed") & F.lower("path").rlike(r"\.(tar|tar\.gz|tgz)$"))
        tars = tars.join(inner, [c for c in ("archive", "path") if c in inner.columns], "left_semi")
        rows = tars.select("archive", "parts", F.struct("start", "size").alias("window"), F.concat("path", F.lit("/")).alias("head"))
        level = rows.repartition(many, "archive", "head").mapInArrow(_indexed, _INDEX)
        out = out.unionByName(level)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents by place: one open archive at a time; a packed one is unpacked as far as its last wanted file."""
    now, raw, plain = None, None, None
    for b in batches:
        for archive, parts, own, packed, place, path, start, size in zip(*(b.column(c).to_pylist() for c in ("archive", "parts", "window", "packed", "place", "path", "start", "size")), strict=True):
            key = (archive, packed and own and own["start"], packed)
            if key != now:
                now, raw = key, _Parts(parts, *((own["start"], own["size"]) if packed and own else ()))
                plain = gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) if packed else raw
            plain.seek(start)  # forward: rows come in order
            content, piece = bytearray(), b"-"
            while len(content) < size and piece:
                piece = plain.read(size - len(content))
                content += piece
            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([place], pa.int64()), pa.array([path]), pa.array([bytes(content)], pa.binary())], ["archive", "place", "path", "content"])


def read_members(archives: DataFrame, wanted: DataFrame | None = None, key: str = "path", nested: bool = False, depth: int = 1) -> DataFrame:
    """(archive, place, path, content) of the files in archives (archive, parts); gzip is undone.

    wanted: names of the members to read, as its column ``key`` (and ``archive``, if it has one). Headers make an index,
    a semi-join of index and names leaves what is wanted, and only that is read, in order of its place: names are never
    gathered, whatever their number. nested: members that are tar files are opened too, if any wanted name begins with
    theirs (``inner.tar/…`` or ``inner/…``), all if no names are given."""
    every = [*(["archive"] if wanted is not None and "archive" in wanted.columns else []), "path"]
    short = lambda c: F.regexp_replace(c, r"\.(tar\.gz|tar|tgz)/", "/")
    names = None if wanted is None else wanted.withColumnRenamed(key, "path").select(*every).where("path is not null")
    inner = None
    if nested and names is None:
        inner = member_index(archives).select("archive", "path")
    elif nested:
        pieces = F.split("path", "/")
        heads = names.withColumn("_k", F.explode(F.sequence(F.lit(1), F.size(pieces)))).withColumn("_h", F.array_join(F.slice(pieces, 1, F.col("_k")), "/")).where(F.col("_k") < F.size(pieces))
        ends = F.explode(F.array(F.lit(""), *map(F.lit, TARS)))
        inner = heads.withColumn("_e", ends).withColumn("path", F.concat("_h", "_e")).select(*every).distinct()
    index = member_index(archives, inner, depth)
    if names is not None:
        known = names.withColumn("_name", short("path")).select(*every[:-1], "_name", F.col("path").alias("_full")).distinct()
        # a name may leave out that an archive in it is one, but need not
        hits = index.withColumn("_name", short("path")).join(known, [*every[:-1], "_name"]).where((F.col("_full") == F.col("path")) | (F.col("_full") == F.col("_name")))
        index = hits.select(index.columns).dropDuplicates(["archive", "path", "place"])
    many = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    run = F.when(F.col("packed"), F.coalesce("window.start", F.lit(-1))).otherwise(F.floor(F.col("start") / RUN_BYTES))  # a packed archive is one task's
    return index.repartition(many, "archive", run).sortWithinPartitions("archive", "packed", F.when(F.col("packed"), F.coalesce("window.start", F.lit(-1))), "start").mapInArrow(_read, "archive string, place long, path string, content binary")


def last_by_name(members: DataFrame) -> DataFrame:
    """One member for each base name: that of the last archive, and the last in it."""
    name = F.regexp_extract("path", r"[^/]*$", 0)
    return members.groupBy(name.alias("name")).agg(F.max_by(F.struct("archive", "path", "content"), F.struct("archive", "place")).alias("m")).select("name", "m.*")


def read_located(locators: DataFrame, folder: str) -> DataFrame:
    """locators (shard, member, header, size, sha256) with content and problem: null, header (the block there is not that
    member's), short or sha256. Rows of a shard are read from one open file, in order."""
    columns = ["shard", "member", "header", "size", "sha256"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        for b in batches:
            content, problem = [], []
            for shard, member, header, size, digest in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if shard != name:
                    system, path = fs.FileSystem.from_uri(folder)
                    name, stream = shard, system.open_input_file(f"{path}/{shard}")
                stream.seek(header)
                block = stream.read(BLOCK)
                try:
                    info = tarfile.TarInfo.frombuf(block, "utf-8", "surrogateescape")
                    wrong = info.name != member or info.size != size
                except tarfile.HeaderError:
                    wrong = True
                data = None if wrong else stream.read(size)
                bad = "header" if wrong else "short" if len(data) < size else "sha256" if hashlib.sha256(data).hexdigest() != digest else None
                content.append(None if bad else data)
                problem.append(bad)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(content, pa.binary()), pa.array(problem, pa.string())], [*columns, "content", "problem"])

    kinds = {"shard": "string", "member": "string", "header": "long", "size": "long", "sha256": "string"}
    rows = locators.select(*(F.col(c).cast(kinds[c]).alias(c) for c in columns)).repartition("shard").sortWithinPartitions("shard", "header")
    return rows.mapInArrow(read, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", content binary, problem string")


# ---- shards ------------------------------------------------------------------------------------------------------


def write_indexed_shards(samples: DataFrame, folder: str, shard: str = "shard", order: str = "place", key: str = "key", content: str = "content", extension: str = "jpg") -> DataFrame:
    """Writes one member a row to tar files, rows of a shard in order, and returns the locators (key, shard, member,
    header, data, size, sha256, shard_bytes, shard_sha256). Files are renamed when whole; a shard is one task's."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = fs.FileSystem.from_uri(folder)
        system.create_dir(where, recursive=True)
        now, rows, stream, digest, at, temporary = None, [], None, None, 0, ""

        def put(data: bytes) -> None:
            nonlocal at
            stream.write(data)
            digest.update(data)
            at += len(data)

        def close() -> pa.RecordBatch:
            put(b"\0" * (2 * BLOCK))
            put(b"\0" * (-at % tarfile.RECORDSIZE))
            stream.close()
            name = f"shard-{now:06d}.tar"
            system.move(temporary, f"{where}/{name}")
            k, member, header, size, sha = zip(*rows, strict=True)
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(k, pa.string()), pa.array([name] * n), pa.array(member, pa.string()), pa.array(header, pa.int64()), pa.array([h + BLOCK for h in header], pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array([at] * n, pa.int64()), pa.array([digest.hexdigest()] * n)],
                ["key", "shard", "member", "header", "data", "size", "sha256", "shard_bytes", "shard_sha256"],
            )

        for b in batches:
            for s, k, data in zip(*(b.column(c).to_pylist() for c in (shard, key, content)), strict=True):
                if s != now:
                    if stream is not None:
                        yield close()
                    now, rows, at, digest, temporary = s, [], 0, hashlib.sha256(), f"{where}/_{uuid.uuid4().hex}"
                    stream = system.open_output_stream(temporary)
                data = data or b""
                info = tarfile.TarInfo(f"{k}.{extension}")
                info.size = len(data)
                rows.append((k, info.name, at, len(data), hashlib.sha256(data).hexdigest()))
                put(info.tobuf(tarfile.USTAR_FORMAT))
                put(data)
                put(b"\0" * (-len(data) % BLOCK))
        if stream is not None:
            yield close()

    rows = samples.select(F.col(shard).cast("long").alias(shard), F.col(order), F.col(key).cast("string").alias(key), F.col(content).cast("binary").alias(content))
    dealt = rows.repartition(shard).sortWithinPartitions(shard, order, key)
    return dealt.mapInArrow(write, "key string, shard string, member string, header long, data long, size long, sha256 string, shard_bytes long, shard_sha256 string")


def gunzipped(content: bytes) -> bytes:
    """A file's bytes, unpacked if they are gzip."""
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
