"""Operators against small cases worked out by hand or by plain Python."""

import io
import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators import audit, curation, metrics, mixture, ordering, telemetry
from lakeloom.sources.tar import read_samples, split_name, write_shards
from lakeloom.streaming.ingest import current, ingest_latest


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_answers(spark):
    df = spark.createDataFrame([("Größe, über!", "['a_b', 'c']", " Left ; right", "The cat, a dog.")], "a string, b string, c string, d string")
    got = df.select(T.plain_answer(F.col("a")), T.list_answer(F.col("b")), T.first_clause(F.col("c")), T.squad_normal(F.col("d"))).first()
    assert tuple(got) == ("größe über", "a b, c", "left", "cat dog")


def test_points_and_captions(spark):
    df = spark.sql("select array(struct(12.39D as x, 99.99D as y), struct(cast(null as double) as x, 1D as y), struct(640.7D as x, 480D as y)) as p, ' ' as blank, cast(null as string) as none")
    got = df.select(T.points_text(F.col("p"), F.lit("cup")), T.caption(F.col("none"), F.col("blank")), T.caption(F.col("none"), F.lit("c"))).first()
    assert tuple(got) == ('<points coords="1 1 123 999;1 3 640 480">cup</points>', "Image.", "c")


def test_rewards(spark):
    good = "<reasoning>\nx\n</reasoning>\n<answer>\ny\n</answer>"
    df = spark.createDataFrame([(good, "y"), ("y", "Y"), ("so y it is", "y"), ("", ""), ("w " * 400, "q")], "t string, a string")
    t = F.col("t")
    got = rows(df.select(T.tag_reward(t), T.concise_reward(t), T.correct_reward(t, F.col("a")), T.between_tags(t)))
    assert got == [(0.75, 0.0, 0.5, "y"), (0.0, 0.0, 1.0, None), (0.0, 0.0, 0.5, None), (0.0, 0.0, 0.0, None), (0.0, 0.5, 0.0, None)]


def test_bleu_and_f1(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "a b", "a b c d"), (3, "x", "y"), (4, "", "y"), (5, "The cat the cat", "cat")], "id long, p string, t string")
    bleu = dict(rows(metrics.bleu(df, ["id"], F.col("p"), F.col("t"))))
    assert bleu[1] == pytest.approx(1.0) and bleu[3] == 0.0 and bleu[4] == 0.0
    assert bleu[2] == pytest.approx(np.exp((np.log(1) + np.log(1) + 2 * np.log(0.1)) / 4 + 1 - 4 / 2))
    f1 = dict(rows(metrics.token_f1(df, ["id"], F.col("p"), F.col("t"))))
    assert f1[1] == 1.0 and f1[3] == 0.0 and f1[4] == 0.0 and f1[5] == pytest.approx(2 * 1 / 3)


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_global_index(spark, n):
    df = spark.range(n).select(((F.col("id") * 37) % 101).alias("k"), "id").repartition(3)
    got = rows(ordering.with_index(df, "k", "id", ranges=8).orderBy("idx"))
    assert [r[2] for r in got] == list(range(n)) and [(r[0], r[1]) for r in got] == sorted((r[0], r[1]) for r in got)
    hashed = df.withColumn("h", F.md5(F.col("id").cast("string").cast("binary")))
    got = rows(ordering.with_hash_index(hashed, "h", "id").orderBy("idx"))
    assert [r[2] for r in got] == sorted(r[2] for r in got) and [r[3] for r in got] == list(range(n))


def test_equal_shards(spark):
    df = spark.range(23).select(ordering.equal_shard(F.col("id"), 23, 5).alias("s"))
    assert sorted(rows(df.groupBy("s").count())) == [(0, 5), (1, 5), (2, 5), (3, 4), (4, 4)]


def test_length_buckets(spark):
    df = spark.createDataFrame([(k, (k * 7) % 10) for k in range(25)], "idx long, len long")
    got = rows(ordering.length_buckets(df, "idx", "len", 10, 3))
    sizes = {}
    for _, _, buffer, bucket in got:
        sizes[buffer, bucket] = sizes.get((buffer, bucket), 0) + 1
    assert sizes == {(0, 0): 3, (0, 1): 3, (0, 2): 4, (1, 0): 3, (1, 1): 3, (1, 2): 4, (2, 0): 1, (2, 1): 1, (2, 2): 3}


def test_nearest_ranks(spark):
    df = spark.createDataFrame([("a", v) for v in [1, 2, 3, 4]] + [("b", 5)], "g string, v long")
    got = sorted(rows(ordering.nearest_ranks(df, ["g"], "v", {"m": 0.5, "p": 0.9})))
    assert got == [("a", 3, 4), ("b", 5, 5)]


def test_mixture(spark):
    datasets = spark.createDataFrame([("a", "x", 2.0, None, False), ("b", "x", None, 0.5, None), ("c", "y", 1.0, None, False), ("d", "x", 1.0, None, True), ("e", "x", 1.0, None, False)], "dataset string, group string, weight double, proportion double, skip boolean")
    overrides = spark.createDataFrame([("a", 5.0, None, 1), ("a", 3.0, 0.1, 2), ("e", 0.0, None, 1)], "dataset string, weight double, proportion double, level int")
    got = mixture.resolve(datasets, spark.createDataFrame([("x",)], "group string"), overrides)
    assert sorted(rows(got.select("dataset", "weight", "proportion"))) == [("a", 3.0, 0.1), ("b", 1.0, 0.5)]
    assert sorted(rows(mixture.shares(got, "weight").select("dataset", "share"))) == [("a", 0.75), ("b", 0.25)]


def test_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "z")], "t string, p string")
    got = {r.label: (r.support, r.precision, r.recall, round(r.f1, 6)) for r in metrics.per_label(df, "t", "p").collect()}
    assert got == {"a": (2, 1.0, 0.5, 0.666667), "b": (2, 0.5, 0.5, 0.5)}
    boot = metrics.clustered_bootstrap(df.withColumn("v", (F.col("t") == F.col("p")).cast("double")), "t", "v", draws=200).first()
    assert boot["mean"] == 0.5 and boot.clusters == 2 and boot.low <= 0.5


def test_run_logs(spark):
    df = spark.createDataFrame([("r", k, 1.0 if k < 10 else 100.0) for k in range(15)] + [("s", k, 2.0) for k in range(4)], "run string, step long, v double")
    got = dict(rows(telemetry.after_warmup(df, ["run"], ["step"], 10).groupBy("run").agg(F.avg("v"))))
    assert got == {"r": 100.0, "s": 2.0}
    assert telemetry.last_k(df, ["run"], ["step"], 3).count() == 6
    busy = spark.createDataFrame([("e", 1, 1.0), ("e", 2, 4.0), ("e", 3, 4.0)], "g string, w long, b double")
    got = telemetry.stragglers(busy, ["g"], "w", "b").first()
    assert (got.least_at, got.most_at, got.ratio, got.straggles) == (1, 2, 4.0, True)


def test_fits(spark):
    points = [("u", float(x), 0.3 * (x - 4) ** 2 + 2) for x in range(1, 9)] + [("d", float(x), -1.0 * x * x) for x in range(5)] + [("few", 1.0, 1.0), ("few", 2.0, 3.0)]
    got = {r.g: r for r in telemetry.parabola(spark.createDataFrame(points, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert set(got) == {"u", "d"} and got["u"].vertex == pytest.approx(4) and got["u"].value == pytest.approx(2) and got["u"].trusted
    assert got["d"].vertex is None and not got["d"].trusted
    law = telemetry.power_law(spark.createDataFrame([("a", 10.0**k, 3 * 10.0 ** (k / 2)) for k in range(5)], "g string, x double, y double"), ["g"], "x", "y").first()
    assert law.exponent == pytest.approx(0.5) and law.log_factor == pytest.approx(np.log10(3))


def test_audits(spark):
    df = spark.createDataFrame([(1, "t", "a"), (2, "v", "a"), (3, "v", None), (4, "t", "b"), (5, "t", "b")], "id long, split string, k string")
    assert rows(audit.leakage(df, "split", content=F.col("k"))) == [("content", "a", "t,v", 2)]
    assert sorted(rows(audit.first_of_equals(df.where("k is not null"), F.col("k"), "id"))) == [(1, 1, 2, True), (2, 1, 2, False), (4, 4, 2, True), (5, 4, 2, False)]
    assert rows(audit.column_profile(df, ["k"])) == [("k", 5, 1, 0, 2, 2)]
    assert sorted(rows(audit.matched_both_ways(df.select("id"), spark.createDataFrame([(5,), (9,)], "id long"), "id"))) == [(1, "left"), (2, "left"), (3, "left"), (4, "left"), (9, "right")]


def test_curation(spark):
    record = "ENTRY       N1\nVARIANT     25v1 x 3v2\n            25v1 7v9\nGENE        1 A"
    fields = curation.record_fields(spark.createDataFrame([(1, record)], "k long, r string"), "k", "r")
    assert [(f, v) for _, _, f, v in sorted(rows(fields))] == [("ENTRY", "N1"), ("VARIANT", "25v1 x 3v2"), ("VARIANT", "25v1 7v9"), ("GENE", "1 A")]
    assert sorted(rows(curation.variant_tokens(fields, "k")), key=lambda r: r[2]) == [(1, "25v1", 0), (1, "3v2", 1), (1, "7v9", 2)]
    df = spark.createDataFrame([("NC:5:A:G",), ("NC:x:A:G",), ("NC:5:A",), ("NC:5::G",)], "s string")
    assert [r.c and tuple(r.c) for r in df.select(curation.coordinates(F.col("s")).alias("c")).collect()] == [("NC", 5, "A", "G"), None, None, ("NC", 5, "", "G")]


def test_tar(spark, tmp_path):
    assert split_name("d/a.b.JPG") == ("a.b", "jpg") and split_name("a.b.jpg", "first") == ("a", "b.jpg") and split_name("README") is None
    assert split_name("x.1.ts.npy", suffixes=("ts.npy",)) == ("x.1", "ts.npy")
    with tarfile.open(tmp_path / "in.tar", "w") as tar:
        for name, data in (("a.txt", b"1"), ("a.json", b"2"), ("b.txt", b"3"), ("noext", b"4"), ("b.txt", b"5"), ("a.txt", b"6")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = [(r.place, r.key, {k: bytes(v) for k, v in r.parts.items()}) for r in read_samples(spark, f"file://{tmp_path}").orderBy("place").collect()]
    assert got == [(0, "a", {"txt": b"1", "json": b"2"}), (1, "b", {"txt": b"5"}), (2, "a", {"txt": b"6"})]
    samples = spark.range(25).select("id", F.when(F.col("id") != 3, F.create_map(F.lit("txt"), F.col("id").cast("string").cast("binary"))).alias("parts"))
    shards = write_shards(samples, f"file://{tmp_path}/out", "id", per_shard=10).orderBy("first").collect()
    assert [(r.shard, r.first, r.samples) for r in shards] == [("shard-000000.tar", 0, 9), ("shard-000001.tar", 10, 10), ("shard-000002.tar", 20, 5)]
    back = read_samples(spark, f"file://{tmp_path}/out").orderBy("key").collect()
    assert [(r.key, bytes(r.parts["txt"])) for r in back] == [(f"{k:08d}", str(k).encode()) for k in range(25) if k != 3]


def test_ingest(spark, tmp_path):
    source, schema = tmp_path / "in", "k string, v long, x double"
    os.mkdir(source)

    def put(name, *own):
        (source / name).write_text("".join(json.dumps(dict(zip(("k", "v", "x"), r, strict=True))) + "\n" for r in own))
        query = ingest_latest(spark, f"file://{source}", schema, f"file://{tmp_path}/t", f"file://{tmp_path}/c", ["k"], "v", buckets=4)
        query.awaitTermination(60)
        return sorted(rows(current(spark, f"file://{tmp_path}/t", schema).select("k", "v", "x")))

    assert put("1.json", ("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, 3.0)) == [("a", 2, 3.0), ("b", 1, 2.0)]
    assert put("2.json", ("a", 1, 9.0), ("c", 5, 4.0), ("b", 7, 5.0)) == [("a", 2, 3.0), ("b", 7, 5.0), ("c", 5, 4.0)]


def test_record_fields_shuffle_nothing_and_tokens_are_dealt(spark):
    df = spark.createDataFrame([(1, "  lost\nA x1v2\n\n   y 3v4 1v2\nB  9v9"), (2, ""), (3, None), (4, "A 5v6\r\nA\n 7v8")], "k long, text string")
    fields = curation.record_fields(df, "k", "text")
    assert "Exchange" not in fields._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows(fields), key=lambda r: r[:2]) == [(1, 0, None, "lost"), (1, 1, "A", "x1v2"), (1, 3, "A", "y 3v4 1v2"), (1, 4, "B", "9v9"), (4, 0, "A", "5v6\r"), (4, 1, "A", ""), (4, 2, "A", "7v8")]
    got = curation.variant_tokens(fields.where("field = 'A'"), "k", records=4)
    assert sorted(rows(got)) == [(1, "1v2", 0), (1, "3v4", 1), (4, "5v6", 0), (4, "7v8", 1)]
