"""Exact packing against one sequential pass, publishing under failures, archives by index and by pushed filters."""

import gzip
import hashlib
import io
import json
import os
import tarfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import packing
from lakeloom.sources import archives, publish


def one_pass(sizes, rows, most_bytes, most_rows):
    out, shard, place, held, n = [], 0, 0, 0, 0
    for k, (size, own) in enumerate(zip(sizes, rows, strict=True)):
        if k and (held >= most_bytes or (most_rows and n >= most_rows)):
            shard, place, held, n = shard + 1, 0, 0, 0
        out.append((k, shard, place))
        place, held, n = place + 1, held + size, n + own
    return out


@pytest.mark.parametrize(
    ("n", "most_bytes", "most_rows", "span", "fan"), [(0, 10, None, 2, 2), (1, 10, 3, 2, 2), (400, 50, None, 2, 3), (90, 1, 1, 4, 2), (400, 300, 40, 2, 4), (400, 10**9, 7, 2, 4), (300, 10**9, None, 64, 64)]
)
def test_packing_is_that_of_one_pass(spark, n, most_bytes, most_rows, span, fan):
    rng = np.random.default_rng(n)
    sizes = rng.integers(0, 100, n) * (rng.random(n) < 0.7)
    sizes[rng.random(n) < 0.02] = 5000  # longer than several ranges
    rows = rng.integers(1, 4, n)
    df = spark.createDataFrame([(k, int(s), int(r)) for k, (s, r) in enumerate(zip(sizes, rows, strict=True))], "i long, s long, r long")
    want = one_pass(sizes.tolist(), rows.tolist(), most_bytes, most_rows)
    got = packing.packed(df.repartition(3), "i", "s", most_bytes, most_rows, "r", span=span, fan=fan).collect()
    assert sorted(map(tuple, got)) == want


def test_running_sums_over_blocks(spark):
    values = [3, 0, None, 5, 1, 1, 7]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long").repartition(3)
    got = packing.running_sums(df, "i", block=2, b=F.coalesce("v", F.lit(0))).orderBy("i").collect()
    plain = [v or 0 for v in values]
    assert [r.b for r in got] == [sum(plain[:k]) for k in range(7)] and [r.b_last for r in got] == [0, *plain[:-1]]


def test_groups_stay_whole_and_follow_ties(spark):
    rows = [(g, g // 3, 10 * (g % 4)) for g in range(40) for _ in range(1 + g % 3)]
    df = spark.createDataFrame(rows, "g long, o long, s long")
    got = {r.g: (r.shard, r.place) for r in packing.packed_groups(df, "g", "o", "s", 60, 9, span=2, fan=2).collect()}
    sizes, counts = [10 * (g % 4) * (1 + g % 3) for g in range(40)], [1 + g % 3 for g in range(40)]
    assert got == {g: (s, p) for g, s, p in one_pass(sizes, counts, 60, 9)}
    assert packing.packed_groups(df.where("false"), "g", "o", "s", 60).collect() == []
    with pytest.raises(ValueError, match="room"):
        packing.packed(df, "g", "s", 0)


# ---- publishing --------------------------------------------------------------------------------------------------


def samples(spark, n, shards=5):
    parts = F.create_map(F.lit("txt"), F.col("id").cast("string").cast("binary"), F.lit("cls"), F.lit("x").cast("binary"))
    return spark.range(n).select((F.col("id") % shards).alias("shard"), (-F.col("id")).alias("place"), F.format_string("%05d", "id").alias("key"), parts.alias("parts"))


def test_a_dataset_appears_whole(spark, tmp_path):
    folder = f"{tmp_path}/set"
    publish.publish_shards(samples(spark, 40), folder)
    assert os.listdir(tmp_path) == ["set"] and sorted(os.listdir(folder)) == ["manifest.json", "shards"]
    manifest = json.load(open(f"{folder}/manifest.json"))
    assert manifest["total_samples"] == 40 and manifest["num_shards"] == 5
    for s in manifest["shards"]:
        raw = open(f"{folder}/shards/{s['name']}", "rb").read()
        assert len(raw) == s["size_bytes"] and hashlib.sha256(raw).hexdigest() == s["sha256"] and s["samples"] == 8
    got = publish.published_shards(spark, folder)
    assert [r.key for r in publish.published_shards(spark, folder, [2, 77]).orderBy("place").collect()] == ["00037", "00032", "00027", "00022", "00017", "00012", "00007", "00002"]
    assert got.first().parts.keys() == {"txt", "cls"} and got.count() == 40
    with pytest.raises(Exception, match="published already"):
        publish.publish_shards(samples(spark, 3), folder)
    assert publish.published_shards(spark, folder).count() == 40 and os.listdir(tmp_path) == ["set"]
    publish.publish_shards(samples(spark, 3), folder, replace=True)
    assert publish.published_shards(spark, folder).count() == 3 and os.listdir(tmp_path) == ["set"]
    publish.publish_shards(samples(spark, 0), f"{tmp_path}/none")
    assert publish.published_shards(spark, f"{tmp_path}/none").count() == 0


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def broken(key):
        if key == "00039":
            raise ValueError("a task dies")
        return key

    with pytest.raises(Exception, match="a task dies"):
        publish.publish_shards(samples(spark, 40).withColumn("key", broken("key")), f"{tmp_path}/set")
    assert os.listdir(tmp_path) == []
    publish.publish_shards(samples(spark, 40), f"{tmp_path}/set")
    with pytest.raises(Exception, match="a task dies"):
        publish.publish_shards(samples(spark, 40).withColumn("key", broken("key")), f"{tmp_path}/set", replace=True)
    assert os.listdir(tmp_path) == ["set"] and publish.published_shards(spark, f"{tmp_path}/set").count() == 40


def _rows(shard, n):
    return pa.RecordBatch.from_pylist([{"shard": shard, "place": k, "key": str(k), "parts": [("txt", b"x")]} for k in range(n)], schema=publish._ARROW)


def test_attempts_that_are_not_reported_leave_no_copy(tmp_path):
    """A task that ran twice, one that died half-way, and a driver that died before the commit."""
    writer = publish.ShardWriter(f"{tmp_path}/set", replace=False)
    first, second = writer.write(iter([_rows(0, 3), _rows(1, 2)])), writer.write(iter([_rows(0, 3), _rows(1, 2)]))

    def dies():
        yield _rows(2, 2)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(dies())
    assert not os.path.exists(f"{tmp_path}/set")  # nothing to be seen before the commit
    other = writer.write(iter([_rows(2, 4)]))
    writer.commit([second, None, other])
    assert os.listdir(tmp_path) == ["set"] and sorted(os.listdir(f"{tmp_path}/set/shards")) == [f"shard-00000{k}.tar" for k in range(3)]
    assert json.load(open(f"{tmp_path}/set/manifest.json"))["total_samples"] == 9
    twice = publish.ShardWriter(f"{tmp_path}/two", replace=False)
    with pytest.raises(ValueError, match="more than one task"):
        twice.commit([twice.write(iter([_rows(0, 1)])), twice.write(iter([_rows(0, 1)]))])
    assert os.listdir(tmp_path) == ["set"] and first.shards[0][2] == 3


# ---- archives ----------------------------------------------------------------------------------------------------


def tar_bytes(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    """An archive in two parts with inner archives, one of which no reader may open, and a packed one."""
    whole = tar_bytes({"free": b"z", "in1.tar": tar_bytes({"p/1": b"x" * 900, "p/2": b"y"}), "in2.tar": b"this is no archive", "in3.tar.gz": tar_bytes({"q": b"g" * 700, "r": b"h"}, "w:gz"), "tail": b"t"})
    (tmp_path / "a.tar.partaa").write_bytes(whole[:2000])
    (tmp_path / "a.tar.partab").write_bytes(whole[2000:])
    (tmp_path / "b.tar.gz").write_bytes(tar_bytes({f"m{k}": bytes([65 + k]) * 3000 for k in range(9)}, "w:gz"))
    return f"file://{tmp_path}"


def read(df):
    return sorted((r.path, bytes(r.content)) for r in df.collect())


def test_only_wanted_members_are_read(spark, folder):
    groups = archives.archive_groups(spark, folder)
    names = spark.createDataFrame([("in1/p/2",), ("in1.tar/p/1",), ("free",), ("m7",), ("m2",), (None,), ("no such",), ("in3/r",)], "path string")
    got = read(archives.read_members(groups, names.unionByName(names), nested=True))
    assert got == [("free", b"z"), ("in1.tar/p/1", b"x" * 900), ("in1.tar/p/2", b"y"), ("in3.tar.gz/r", b"h"), ("m2", b"C" * 3000), ("m7", b"H" * 3000)]
    assert read(archives.read_members(groups, names.where("false"), nested=True)) == []
    one = spark.createDataFrame([("free", groups.where("archive like '%b.tar.gz'").first().archive)], "name string, archive string")
    assert read(archives.read_members(groups, one, key="name")) == []
    flat = [p for p, _ in read(archives.read_members(groups))]
    assert flat == ["free", "in1.tar", "in2.tar", "in3.tar.gz", *(f"m{k}" for k in range(9)), "tail"]


def test_many_names_pass_through_no_single_row(spark, folder):
    """Names stay rows: no aggregate gathers them, and a hundred thousand find the three that are there."""
    names = spark.range(100_000).select(F.concat(F.lit("m"), F.col("id")).alias("path"))
    out = archives.read_members(archives.archive_groups(spark, folder), names)
    assert sorted(r.path for r in out.collect()) == [f"m{k}" for k in range(9)]
    plan = out._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_windows_and_parts_are_read_alike(tmp_path):
    data = bytes(range(256)) * 40
    for k, (lo, hi) in enumerate([(0, 1000), (1000, 1001), (1001, 10_240)]):
        (tmp_path / str(k)).write_bytes(data[lo:hi])
    parts = archives._Parts([f"file://{tmp_path}/{k}" for k in range(3)], 990, 5000)
    assert parts.read() == data[990:5990] and parts.seek(-10, io.SEEK_END) == 4990 and parts.read(20) == data[5980:5990] and parts.seek(11) == 11
    assert io.BufferedReader(parts, 64).read(100) == data[1001:1101] and gzip.decompress(gzip.compress(data)) == data
