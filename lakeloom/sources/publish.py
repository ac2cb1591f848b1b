"""Datasets of tar shards that are published whole or not at all, as a data source of Spark's.

Tasks write shards under names of their own in a hidden folder beside the dataset and report them. Only when all have
done so does the commit give the reported files their names, write the manifest and rename the folder to the dataset's
name: readers see the old dataset or the new one. What a failed or a slower second attempt has written is in no report
and goes; a job that fails removes its folder."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "shard_dataset"
SCHEMA = "shard long, place long, key string, parts map<string,binary>"
_PARTS = pa.map_(pa.string(), pa.binary())
_ARROW = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("key", pa.string()), ("parts", _PARTS)])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    system, where = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")
    return system, where.rstrip("/")


def _there(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: (shard, file, samples, bytes, sha-256) of each shard."""

    shards: list[tuple[int, str, int, int, str]]


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, replace: bool) -> None:
        self.path, self.replace, self.job = path, replace, uuid.uuid4().hex

    def _folders(self) -> tuple[fs.FileSystem, str, str]:
        system, where = _opened(self.path)
        return system, where, f"{where}.incomplete-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, building = self._folders()
        system.create_dir(f"{building}/attempts", recursive=True)
        done, now, stream, tar, name, n = [], None, None, None, "", 0

        def close() -> None:
            tar.close()
            stream.close()
            done.append((now, name, n, stream.size, stream.digest.hexdigest()))

        for b in iterator:
            for shard, key, parts in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("shard", "key", "parts")), strict=True):
                if shard != now:
                    if tar is not None:
                        close()
                    now, name, n = shard, f"{building}/attempts/{uuid.uuid4().hex}.tar", 0
                    stream = _Measured(system.open_output_stream(name))
                    tar = tarfile.open(fileobj=stream, mode="w|", format=tarfile.USTAR_FORMAT)
                for extension, data in parts or ():
                    info = tarfile.TarInfo(f"{key}.{extension}")
                    info.size = len(data or b"")
                    tar.addfile(info, io.BytesIO(data or b""))
                n += 1
        if tar is not None:
            close()
        return Written(done)

    def commit(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        system, where, building = self._folders()
        shards = sorted(s for m in messages if m for s in m.shards)  # a row a shard
        if len({s[0] for s in shards}) < len(shards):
            self.abort(messages)
            raise ValueError("a shard was written by more than one task: deal rows by shard")
        system.create_dir(f"{building}/shards", recursive=True)
        for shard, file, *_ in shards:
            system.move(file, f"{building}/shards/shard-{shard:06d}.tar")
        if _there(system, f"{building}/attempts"):
            system.delete_dir(f"{building}/attempts")
        manifest = {
            "num_shards": len(shards),
            "total_samples": sum(s[2] for s in shards),
            "size_bytes": sum(s[3] for s in shards),
            "shards": [{"name": f"shard-{s[0]:06d}.tar", "shard": s[0], "samples": s[2], "size_bytes": s[3], "sha256": s[4]} for s in shards],
        }
        with system.open_output_stream(f"{building}/manifest.json") as out:
            out.write(json.dumps(manifest, indent=1).encode())
        old = f"{where}.replaced-{self.job}"
        if _there(system, where):
            if not self.replace:
                self.abort(messages)
                raise FileExistsError(f"{where} has been published already")
            system.move(where, old)
        system.move(building, where)
        if _there(system, old):
            system.delete_dir(old)

    def abort(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        system, _, building = self._folders()
        if _there(system, building):
            system.delete_dir(building)


class _Measured(io.RawIOBase):
    """A stream that counts and digests what is written to it."""

    def __init__(self, stream) -> None:
        self.stream, self.size, self.digest = stream, 0, hashlib.sha256()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(data)
        self.digest.update(data)
        self.size += len(data)
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


@dataclass
class Shard(InputPartition):
    name: str
    shard: int
    samples: int


class ShardReader(DataSourceReader):
    """Reads the shards that the manifest lists, or those of them that are named, a partition each.

    It takes no pushed filters: Spark keeps these with the relation, so that a second query over the same DataFrame would
    see only what the first had asked for."""

    def __init__(self, path: str, only: set[int] | None) -> None:
        self.path, self.only = path, only

    def partitions(self) -> Sequence[InputPartition]:
        system, where = _opened(self.path)
        with system.open_input_stream(f"{where}/manifest.json") as raw:
            listed = json.loads(raw.read())["shards"]
        return [Shard(s["name"], s["shard"], s["samples"]) for s in listed if self.only is None or s["shard"] in self.only]

    def read(self, partition: Shard | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no shards
            return
        system, where = _opened(self.path)
        key, parts, place = None, [], 0
        with system.open_input_stream(f"{where}/shards/{partition.name}") as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
            for m in tar:
                stem, _, extension = m.name.rpartition(".")
                if stem != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pylist([{"shard": partition.shard, "place": place, "key": key, "parts": parts}], schema=_ARROW)
                        place += 1
                    key, parts = stem, []
                parts.append((extension, tar.extractfile(m).read()))
            if key is not None:
                yield pa.RecordBatch.from_pylist([{"shard": partition.shard, "place": place, "key": key, "parts": parts}], schema=_ARROW)


class ShardDataset(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        named = self.options.get("shards")
        return ShardReader(self.options["path"], None if named is None else {int(x) for x in named.split(",") if x})

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], overwrite)


def publish_shards(samples: DataFrame, folder: str, shard: str = "shard", order: str = "place", key: str = "key", parts: str = "parts", replace: bool = False) -> None:
    """Writes samples (a map of extension to bytes a row) as the dataset ``folder``: a tar file a shard, rows in order,
    and a manifest, visible all at once. A dataset that is there is replaced, or left with an error. A shard is one task's;
    keys keep their dots out of the last place, so that extensions are told apart."""
    spark = samples.sparkSession
    spark.dataSource.register(ShardDataset)
    rows = samples.select(F.col(shard).cast("long").alias("shard"), F.col(order).cast("long").alias("place"), F.col(key).cast("string").alias("key"), F.col(parts).alias("parts"))
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "place", "key")
    dealt.write.format(FORMAT).mode("overwrite" if replace else "append").save(folder)


def published_shards(spark: SparkSession, folder: str, shards: list[int] | None = None) -> DataFrame:
    """(shard, place, key, parts) of a published dataset, or of the named shards of it; others are not opened."""
    spark.dataSource.register(ShardDataset)
    reader = spark.read.format(FORMAT)
    return (reader if shards is None else reader.option("shards", ",".join(map(str, shards)))).load(folder)
