"""Keys by BLAKE2b, exact draws, ranks under ties, settings, ingestion and buckets of a stream, against plain Python."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import blake2
from lakeloom.operators import metrics, ordering, rules, sampling
from lakeloom.streaming import ingest
from lakeloom.streaming.buckets import bucketed_lengths


def test_digests_are_those_of_hashlib():
    rng = random.Random(1)
    messages = [rng.randbytes(rng.choice([0, 1, 5, 40, 127, 128, 129, 255, 256, 257, 1000])) for _ in range(10_000)]
    for size in (1, 8, 16, 64):
        assert [r.tobytes() for r in blake2.digests(messages, size)] == [hashlib.blake2b(m, digest_size=size).digest() for m in messages]
    assert blake2.digests([], 8).shape == (0, 8)


def test_global_order_by_keys(spark):
    rows = [("g", f"d{k % 3}", f"/x/y/shard-{k % 4}.tar", f"kéy{k}") for k in range(200)] + [("g", "d", "s.tar", "same")] * 2 + [("g", None, "s.tar", "k")]
    df = spark.createDataFrame(rows, "g string, d string, s string, k string").repartition(4)
    key = lambda r: hashlib.blake2b(b"\0".join((x or "").encode() for x in ("42", r[0], r[1], r[2].rsplit("/", 1)[-1], r[3])), digest_size=16).hexdigest()
    got = blake2.shuffled(df, 42, "g", "d", "s", "k").orderBy("idx").collect()
    assert [(r.random_key, r.k) for r in got] == sorted((key(r), r[3]) for r in rows) and [r.idx for r in got] == list(range(203))


def test_stable_split(spark):
    df = spark.range(500).withColumn("id", F.concat(F.lit("m"), "id"))
    share = lambda i: int.from_bytes(hashlib.blake2b(f"17:{i}".encode(), digest_size=8).digest(), "big") / 2**64
    want = {i: "val" if share(i) < 0.1 else "test" if share(i) < 0.3 else "train" for i in (f"m{k}" for k in range(500))}
    assert {r.id: r.split for r in blake2.stable_split(df, "id", 0.1, 0.2).collect()} == want
    with pytest.raises(ValueError, match="empty"):
        blake2.stable_split(df.limit(2), "id", 0.1, 0.1)
    with pytest.raises(ValueError, match="less than 1"):
        blake2.stable_split(df, "id", 0.5, 0.5)


@pytest.mark.parametrize(("clusters", "leaf"), [(2, 4096), (37, 4), (64, 8), (5, 1)])
def test_draws_of_leaves_add_up(clusters, leaf):
    for draw in range(50):
        counts = np.concatenate([metrics.leaf_draws(3, draw, clusters, k, leaf) for k in range(-(-clusters // leaf))])
        assert len(counts) == clusters and counts.sum() == clusters
    mean = np.mean([np.concatenate([metrics.leaf_draws(3, d, clusters, k, leaf) for k in range(-(-clusters // leaf))]) for d in range(1500)], axis=0)
    assert np.abs(mean - 1).max() < 0.15  # each cluster comes once on average


def test_paired_bootstrap_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(f"c{rng.randrange(23):02d}", rng.gauss(1, 1), rng.gauss(0.4, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "c string, x double, y double").repartition(3)
    got = metrics.paired_bootstrap(df, "c", "x", "y", draws=200, alpha=0.05, seed=9, leaf=4).first()
    names = sorted({c for c, *_ in rows})
    sums = np.array([[sum(x - y for c, x, y in rows if c == n), sum(c == n for c, *_ in rows)] for n in names])
    means = []
    for d in range(200):
        counts = np.concatenate([metrics.leaf_draws(9, d, 23, k, 4) for k in range(6)])
        total, n = counts @ sums
        means.append(total / n)
    assert got.low == pytest.approx(sorted(means)[math.ceil(0.05 * 200) - 1]) == pytest.approx(metrics.bound(means, 0.05))
    assert got.difference == pytest.approx(sums[:, 0].sum() / 300) and (got.clusters, got.cases, got.draws) == (23, 300, 200)
    for wrong in ([("a", 1.0, 2.0)], [("a", 1.0, 2.0), ("b", float("nan"), 1.0)], [("a", 1.0, 2.0), ("b", None, 1.0)]):
        with pytest.raises(ValueError, match="clusters|finite"):
            metrics.paired_bootstrap(spark.createDataFrame(wrong, "c string, x double, y double"), "c", "x", "y")


@pytest.mark.parametrize("most", [10, 10**9])
def test_ranks_and_totals_under_ties(spark, most):
    """A hot group with one value of the first column, and with two of the first and one of the second."""
    rng = random.Random(2)
    rows = [("hot", 5, None, k) for k in range(400)] + [("two", k % 2, "same text", 1000 + k) for k in range(300)] + [(rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]), 2000 + k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, a int, t string, id long").repartition(4)
    nulls = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (nulls(r[1]), text(r[2]), r[3]))
        total = 0
        for k, r in enumerate(own):
            total += r[3]
            want[r[3]] = (k, len(own), k + 1, total)
    ranked = {r.id: (r.rank, r.n) for r in sampling.ranked_in_group(df, "g", "a", "t", "id", ranges=8, most=most).collect()}
    running = {r.id: (r.steps, r.total) for r in sampling.running_in_group(df, "g", "id", "a", "t", "id", ranges=8, most=most).collect()}
    assert {i: (*ranked[i], *running[i]) for i in ranked} == want
    if most == 10:
        parted = sampling._parted(df.where("g = 'hot'"), "g", ("a", "id"), 8, 10)
        assert parted.groupBy("_part").count().agg(F.max("count")).first()[0] < 100  # 400 rows of one value are spread by the next column


def test_compatible_settings_meet_by_their_rarest_need(spark):
    presets = [(1, ["a", "b"]), (2, ["a"]), (3, []), (4, ["z"]), (5, ["a", None, "b"]), (2, ["a"])]
    designs = [(10, ["a", "b", "c"], ["a"]), (11, ["a"], []), (12, [], []), (13, ["b", "a"], ["b"]), (14, ["a", "b"], [None])]
    got = rules.compatible(spark.createDataFrame(presets, "p int, needs array<string>"), spark.createDataFrame(designs, "d int, offers array<string>, requires array<string>"), "needs", "offers", "requires")
    some = lambda xs: {x for x in xs if x is not None}
    want = [(p, d) for p, n in presets for d, o, r in designs if some(n) <= set(o) and some(r) <= some(n)]
    assert sorted((r.p, r.d) for r in got.collect()) == sorted(want)


def test_ingestion_keeps_two_versions_of_a_bucket(spark, tmp_path):
    source, target, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    schema = "k long, v long, t string"
    for turn in range(5):
        rows = [{"k": k, "v": turn // 2, "t": f"{turn}-{k}"} for k in range(turn, turn + 6)]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{turn}.json").write_text("\n".join(map(json.dumps, rows)))
        ingest.ingest_latest(spark, source, schema, target, check, ["k"], "v", buckets=3).awaitTermination()
    best = {}
    for turn in range(5):
        for k in range(turn, turn + 6):
            best[k] = max(best.get(k, (-1, "")), (turn // 2, f"{turn}-{k}"))
    assert {r.k: (r.v, r.t) for r in ingest.current(spark, target, schema).collect()} == best  # of equal versions the later text
    per = {}
    for n, b in ingest._folders(spark, target):
        per.setdefault(b, []).append(n)
    assert all(len(v) <= 2 for v in per.values()) and ingest.current(spark, f"{tmp_path}/none", schema) is None


def test_buckets_of_a_stream_are_those_of_the_table(spark, tmp_path):
    """Rows of two lanes in three batches, out of order, with a restart from the checkpoint after each."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng = random.Random(4)
        lengths = [(lane, k, rng.randrange(100)) for lane in (0, 1) for k in range(11)]
        rng.shuffle(lengths)
        (tmp_path / "in").mkdir()
        for turn, part in enumerate((lengths[:5], lengths[5:], [(0, None, None), (1, None, None)])):
            (tmp_path / "in" / f"{turn}.json").write_text("\n".join(json.dumps(dict(zip(("lane", "idx", "length"), r, strict=True))) for r in part))
            stream = spark.readStream.schema("lane long, idx long, length long").json(f"{tmp_path}/in")
            query = bucketed_lengths(stream, 4, 2).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out")
            assert query.awaitTermination(90) and query.exception() is None
        got = spark.read.parquet(f"{tmp_path}/out").collect()
        table = spark.createDataFrame(lengths, "lane long, idx long, length long")
        want = [(lane, r.buffer, r.bucket, r.idx, r.length) for lane in (0, 1) for r in ordering.length_buckets(table.where(F.col("lane") == lane), "idx", "length", 4, 2).collect()]
        assert sorted(map(tuple, got)) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
