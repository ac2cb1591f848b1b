"""Tar shards of samples: a streaming scan and a fixed-count sink."""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.samples import split_answer
from lakeloom.operators.ordering import with_index

_PARTS = pa.map_(pa.string(), pa.binary())


def split_name(name: str, split: str = "last", suffixes: tuple[str, ...] = ()) -> tuple[str, str] | None:
    """(key, extension in lower case) of a member's base name: the first of ``suffixes`` that ends it, else at its last
    (or first) dot; None without a dot."""
    base = name.rsplit("/", 1)[-1]
    for s in suffixes:
        if base.lower().endswith(f".{s}") and len(base) > len(s) + 1:
            return base[: -len(s) - 1], s
    head, dot, tail = base.rpartition(".") if split == "last" else base.partition(".")
    return (head, tail.lower()) if dot and head else None


def read_samples(spark: SparkSession, path: str, split: str = "last", suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(shard, place, key, parts) for each sample of the tar files under ``path``; parts: extension -> bytes.

    Neighbouring members with one key are a sample (of members with equal extensions the last counts); a key that
    comes back later is another sample. Links, folders and names without a dot are passed over. Shards are listed by
    Spark and streamed in tasks, which hold one sample at a time."""
    shards = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").option("recursiveFileLookup", "true").load(path).select("path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("path").to_pylist():
                system, where = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(where) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                    place, key, parts = 0, None, {}

                    def row() -> pa.RecordBatch:
                        return pa.RecordBatch.from_arrays([pa.array([uri.rsplit("/", 1)[-1]]), pa.array([place], pa.int64()), pa.array([key]), pa.array([list(parts.items())], _PARTS)], ["shard", "place", "key", "parts"])  # noqa: B023

                    for member in tar:
                        named = split_name(member.name, split, suffixes) if member.isfile() else None
                        if named is None:
                            continue
                        if named[0] != key:
                            if key is not None:
                                yield row()
                                place += 1
                            key, parts = named[0], {}
                        parts[named[1]] = tar.extractfile(member).read()
                    if key is not None:
                        yield row()

    return shards.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(scan, "shard string, place long, key string, parts map<string,binary>")


def merged_samples(samples: DataFrame) -> DataFrame:
    """(key, parts) of samples wherever their members stand: of equal extensions of a key the last shard's, and there the
    last, counts."""
    each = samples.select("key", "shard", "place", F.explode("parts").alias("extension", "content"))
    last = each.groupBy("key", "extension").agg(F.max_by("content", F.struct("shard", "place")).alias("content"))
    return last.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("extension", "content"))).alias("parts"))  # a sample's parts


def question_samples(spark: SparkSession, path: str, series: str = "ts.npy", text: str = "text") -> DataFrame:
    """(key, series, question, answer) of samples that have both parts, names cut at their first dot; the text is cut at
    its first ``Answer:``."""
    rows = read_samples(spark, path, split="first").withColumn("_t", F.decode(F.try_element_at("parts", F.lit(text)), "UTF-8")).withColumn("series", F.try_element_at("parts", F.lit(series)))
    return rows.where("_t is not null and series is not null").select("key", "series", split_answer(F.col("_t")).alias("q")).select("key", "series", "q.question", "q.answer")


def sampled_lengths(samples: DataFrame, most: int, extension: str = "txt") -> DataFrame:
    """(shard, key, bytes): the size of a part of the first ``most`` samples of each shard, by their place in it."""
    return samples.where(F.col("place") < most).select("shard", "key", F.octet_length(F.try_element_at("parts", F.lit(extension))).alias("bytes"))


def shard_manifest(shards: DataFrame, dataset: str, sources: DataFrame | None = None) -> DataFrame:
    """One row: a manifest's dataset, counts, and its shards in order as JSON, from rows (shard, samples, bytes), and how
    many samples each of ``sources`` (source, n) gave. A row a shard comes together in one."""
    out = shards.agg(
        F.lit(dataset).alias("dataset"), F.count(F.lit(1)).alias("num_shards"), F.coalesce(F.sum("samples"), F.lit(0)).alias("total_samples"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"),
        F.to_json(F.array_sort(F.collect_list(F.struct(F.col("shard").alias("name"), "samples", F.col("bytes").alias("size_bytes"))))).alias("shards"),
    )
    if sources is None:
        return out
    return out.join(sources.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n"))))).alias("source_counts")))  # one row each


def write_shards(samples: DataFrame, folder: str, order: str, per_shard: int = 1000, parts: str = "parts", prefix: str = "shard") -> DataFrame:
    """Writes tar files of ``per_shard`` samples in the order of the number ``order`` and returns (shard, first, samples,
    bytes) of each. Keys are places as ``%08d``; a sample without parts leaves its key out. Files are renamed when whole."""
    rows = with_index(samples.select(order, parts), order).withColumn("shard", F.floor(F.col("idx") / per_shard).cast("long"))
    dealt = rows.select("shard", "idx", F.col(parts).alias("parts")).repartition("shard").sortWithinPartitions("shard", "idx")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = fs.FileSystem.from_uri(folder)
        system.create_dir(where, recursive=True)
        tar, stream, now, first, n, size, temporary = None, None, None, 0, 0, 0, ""

        def close() -> pa.RecordBatch:
            tar.close()
            stream.close()
            system.move(temporary, f"{where}/{(name := f'{prefix}-{now:06d}.tar')}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["shard", "first", "samples", "bytes"])

        for b in batches:
            for shard, idx, own in zip(*(b.column(c).to_pylist() for c in ("shard", "idx", "parts")), strict=True):
                if shard != now:
                    if tar is not None:
                        yield close()
                    now, first, n, size, temporary = shard, idx, 0, 0, f"{where}/_{uuid.uuid4().hex}"
                    stream = system.open_output_stream(temporary)
                    tar = tarfile.open(fileobj=stream, mode="w|", format=tarfile.USTAR_FORMAT)
                if not own:
                    continue
                n += 1
                for extension, data in own:
                    info = tarfile.TarInfo(f"{idx:08d}.{extension}")
                    info.size = len(data)
                    size += len(data)
                    tar.addfile(info, io.BytesIO(data))
        if tar is not None:
            yield close()

    return dealt.mapInArrow(write, "shard string, first long, samples long, bytes long")
