"""Sources and writers over files of their own, and operators on odd rows."""

import base64
import hashlib
import io
import tarfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import audit, matching, ordering, packing, pairing, rules, scoring
from lakeloom.functions import records
from lakeloom.sources import archives, manifests, tables


def _tar(members: dict[str, bytes], mode: str = "w") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_split_archives_are_read_as_one(spark, tmp_path):
    whole = _tar({"a/1.png": b"one" * 5000, "a/2.png": b"two", "b/1.png": b"last"}, "w:gz")
    cut = len(whole) // 2
    (tmp_path / "x.tar.gz.partaa").write_bytes(whole[:cut])
    (tmp_path / "x.tar.gz.partab").write_bytes(whole[cut:])
    (tmp_path / "y.tar").write_bytes(_tar({"a/1.png": b"newer"}))
    groups = archives.archive_groups(spark, f"file://{tmp_path}")
    got = archives.read_members(groups).collect()
    assert sorted((r.archive.rsplit("/", 1)[-1], r.path, len(r.content)) for r in got) == [("x.tar.gz", "a/1.png", 15000), ("x.tar.gz", "a/2.png", 3), ("x.tar.gz", "b/1.png", 4), ("y.tar", "a/1.png", 5)]
    some = archives.read_members(groups, spark.createDataFrame([("a/2.png",)], "path string")).collect()
    assert [bytes(r.content) for r in some] == [b"two"]
    last = {r.name: bytes(r.content) for r in archives.last_by_name(archives.read_members(groups)).collect()}
    assert last == {"1.png": b"newer", "2.png": b"two"}


def test_nested_archives_open_only_what_is_wanted(spark, tmp_path):
    (tmp_path / "outer.tar").write_bytes(_tar({"in1.tar": _tar({"p/1": b"x", "p/2": b"y"}), "in2.tar": b"this is no archive", "free": b"z"}))
    groups = archives.archive_groups(spark, f"file://{tmp_path}")
    wanted = spark.createDataFrame([("in1/p/2",), ("free",)], "path string")
    assert sorted((r.path, bytes(r.content)) for r in archives.read_members(groups, wanted, nested=True).collect()) == [("free", b"z"), ("in1.tar/p/2", b"y")]


def test_indexed_shards_and_located_members(spark, tmp_path):
    rows = [(g, k, f"{g}-{k}", bytes([65 + k]) * (700 * (k + 1))) for g in range(6) for k in range(3)]
    df = spark.createDataFrame(rows, "g long, k long, key string, content binary").withColumn("o", F.col("g") * 10 + F.col("k"))
    packed = packing.packed_groups(df.withColumn("bytes", F.octet_length("content")), "g", "o", "bytes", 8000)
    plan = {r.g: r.shard for r in packed.collect()}
    assert plan == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}  # 4,200 bytes a group; a shard closes from 8,000 on
    folder = f"file://{tmp_path}/shards"
    index = archives.write_indexed_shards(df.join(packed.select("g", "shard"), "g"), folder, order="o").cache()
    got = index.collect()
    for r in got:
        raw = (tmp_path / "shards" / r.shard).read_bytes()
        assert len(raw) == r.shard_bytes and hashlib.sha256(raw).hexdigest() == r.shard_sha256 and r.data == r.header + 512
        with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
            assert tar.getnames() == sorted(tar.getnames())
    assert rules.violations(index, "key", rules.locator_rules("header", "data", "size", "member", "key", "shard_bytes")).count() == 0
    read = archives.read_located(index, folder).collect()
    assert len(read) == 18 and all(r.problem is None and hashlib.sha256(r.content).hexdigest() == r.sha256 for r in read)
    moved = archives.read_located(index.withColumn("header", F.col("header") + 512), folder)
    assert {r.problem for r in moved.collect()} == {"header"}
    assert {r.problem for r in archives.read_located(index.withColumn("sha256", F.lit("0")), folder).collect()} == {"sha256"}


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("smiles;text\nC=O;an aldehyde\nCC;\n;none\n")
    got = tables.sniffed(spark, f"file://{tmp_path}/a.csv", {"smiles": "SMILES", "text": "description"}, ("SMILES", "description")).collect()
    assert [tuple(r) for r in got] == [("C=O", "an aldehyde")]
    (tmp_path / "b.tsv").write_text("x\ty\n1\t\n2\t b\n")
    assert [tuple(r) for r in tables.text_table(spark, f"file://{tmp_path}/b.tsv").collect()] == [("1", ""), ("2", " b")]
    assert tables.delimited(spark, f"file://{tmp_path}/b.tsv", "ChEBI-20").columns == ["x", "y"]
    df = spark.createDataFrame([(2, None), (1, "p")], "id int, v string")
    tables.write_delimited(df, f"file://{tmp_path}/out", ["v", "gone", "id"], order="id")
    assert [tuple(r) for r in tables.text_table(spark, f"file://{tmp_path}/out").orderBy("id").collect()] == [("p", "", "1"), ("", "", "2")]
    assert tables.union_schema(df, df.withColumn("z", F.lit(1)), first="v").columns == ["v", "id", "z"]


def test_arrow_and_series_files(spark, tmp_path):
    table = pa.table({"a": [1, 2], "b": ["x", None]})
    with pa.ipc.new_file(str(tmp_path / "f.arrow"), table.schema) as w:
        w.write_table(table)
    with pa.ipc.new_stream(str(tmp_path / "s.arrow"), table.schema) as w:
        w.write_table(table)
    got = tables.arrow_files(spark, f"file://{tmp_path}", "a long, b string, c double").collect()
    assert sorted((r.a, r.b or "", r.c) for r in got) == [(1, "x", None), (1, "x", None), (2, "", None), (2, "", None)]
    series = tmp_path / "series"
    series.mkdir()
    np.save(series / "n.npy", np.array([[1, 2], [3, 4]]))
    (series / "v.csv").write_bytes(b"\xef\xbb\xbf1.5,2\n3\n")
    (series / "t.csv").write_text("0.5\nX\n1\n")
    (series / "bad.csv").write_text("one\n")
    rows = {r.file: (r.numbers, r.texts) for r in tables.series_files(spark, f"file://{series}").collect()}
    assert rows == {"n.npy": ([1, 2, 3, 4], None), "v.csv": ([1.5, 2, 3], None), "t.csv": (None, ["0.5", "X", "1"]), "bad.csv": (None, None)}


def test_episodes_and_training_files(spark, tmp_path):
    for k in (0, 1, 21000):
        spark.createDataFrame([(k, "x", 1.0)], "step long, note string, action double").toPandas().to_parquet(tmp_path / f"episode_{k:06d}.parquet")
    assert sorted(tuple(r) for r in tables.episode_chunks(spark, f"file://{tmp_path}", ["action"]).collect()) == [(0, 1.0), (1, 1.0)]
    names = tmp_path / "names"
    names.mkdir()
    for n in ("train-0", "Test-0", "validation-1"):
        spark.createDataFrame([(n,)], "n string").toPandas().to_parquet(names / f"{n}.parquet")
    assert [r.n for r in tables.train_files(spark, f"file://{names}").collect()] == ["train-0"]
    many = tmp_path / "many"
    for k in range(4):
        spark.range(10 * k, 10 * k + 10, 1, 1).write.parquet(f"file://{many}/part{k}")
    first = [sorted(r.id for r in tables.train_files(spark, f"file://{many}", limit=25).collect()) for _ in range(2)]
    assert first == [list(range(25))] * 2


def test_tensors(spark):
    f4, f2 = np.array([1, -2.5], dtype="<f4"), np.array([0.5], dtype="<f2")
    code = lambda b: base64.b64encode(b).decode()
    rows = [(1, code(f4.tobytes()), "f32", [2, 1]), (2, code(f2.tobytes()), "f16", [1]), (3, code(f4.view("<u4").astype("<u4").__rshift__(16).astype("<u2").tobytes()), "bf16", [2]), (4, code(b"xx"), "f32", [1]), (5, code(b"xxxx"), "f64", [1]), (6, code(b""), "f32", [0]), (7, "*", "f32", [1])]
    got = {r.id: (r["values"], r.problem) for r in tables.decoded_tensors(spark.createDataFrame(rows, "id int, p string, k string, s array<long>"), "p", "k", "s").collect()}
    assert got == {1: ([1, -2.5], None), 2: ([0.5], None), 3: ([1, -2.5], None), 4: (None, "size"), 5: (None, "dtype"), 6: (None, "shape"), 7: (None, "base64")}


def test_chunks_resume(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    rows = spark.range(10).selectExpr("id", "id div 4 as chunk")
    assert {(r.chunk, r["rows"]) for r in tables.write_chunks(rows.where("chunk < 2"), path, "chunk").collect()} == {(0, 4), (1, 4)}
    assert {(r.chunk, r["rows"]) for r in tables.write_chunks(rows, path, "chunk").collect()} == {(0, 4), (1, 4), (2, 2)}
    assert [r.chunk for r in tables.missing_chunks(rows.select("chunk").distinct(), spark.read.parquet(path).groupBy("chunk").count().withColumnRenamed("count", "rows"), "chunk").collect()] == []
    done = spark.createDataFrame([("a", 3)], "dataset string, shards long")
    assert tables.is_converted(done, "a", 3) and not tables.is_converted(done, "a", 4) and not tables.is_converted(done, "a", 3, sampled=True) and not tables.is_converted(done, "b", 1)
    lines, mark = tables.lines_manifest(rows, ["id"], "id")
    assert lines.first().value == '{"id":0}' and mark.first()["rows"] == 10


def test_fasta_cuts_at_line_starts_only(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 a->b\nAC\ngt\n>chr2\nNN\n")
    assert [tuple(r) for r in manifests.fasta(spark, f"file://{tmp_path}/g.fa").collect()] == [("chr1", "ACGT"), ("chr2", "NN")]


@pytest.mark.parametrize("rows", [50, 1])
def test_a_global_order_survives_ties(spark, monkeypatch, rows):
    monkeypatch.setattr(ordering, "RANGE_ROWS", rows)
    df = spark.range(1200).selectExpr("if(id % 3 = 0, 7, cast(if(id % 5 = 0, null, id % 11) as int)) a", "cast(if(id % 4 = 0, null, id % 2) as string) b", "id d").repartition(3)
    got = [tuple(r)[:3] for r in ordering.with_index(df, "a", "b", "d", ranges=16).orderBy("idx").collect()]
    assert got == [tuple(r) for r in df.orderBy(*(F.col(c).asc_nulls_first() for c in "abd")).collect()]
    one = ordering.with_index(df.select(F.lit(1).alias("k"), "d"), "k", "d", ranges=8)
    assert [r.d for r in one.orderBy("idx").collect()] == list(range(1200))
    assert ordering.with_index(df.limit(0), "a", "b").collect() == []


def test_texts_with_one_beginning_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 10)
    df = spark.range(300).selectExpr("concat('shard-with-a-very-long-common-beginning-', lpad(id % 70, 4, '0')) s", "300 - id d")
    got = [tuple(r)[:2] for r in ordering.with_index(df, "s", "d", ranges=8).orderBy("idx").collect()]
    assert got == sorted(got)


def test_paths_all_matched_or_null(spark):
    files = spark.createDataFrame([("a/1.png", 1), ("b/1.png", 2)], "file string, v int")
    rows = spark.createDataFrame([("a/1.png",), ("c/1.png",), (None,), ("x",)], "path string")
    got = {(r.path, r.v, r.how) for r in matching.by_path(rows, "path", files, "file", "v").collect()}
    assert got == {("a/1.png", 1, "path"), ("c/1.png", 1, "name"), (None, None, "none"), ("x", None, "none")}


def test_fingerprints_tell_null_from_empty(spark):
    of = lambda rows: audit.fingerprint(spark.createDataFrame(rows, "v string"), ["v"], bucket_rows=2).first()
    assert of([(None,)]) != of([("",)]) and of([("a",), ("b",), ("c",)]) == of([("c",), ("a",), ("b",)])
    assert of([("a",), ("a",)]) != of([("a",)])


def test_odd_rows(spark):
    none = spark.createDataFrame([], "truth int, said int")
    got = scoring.summary(none, "truth", "said", F.lit(True), F.lit(False)).first()
    assert tuple(got) == (0, 0.0, 0.0, 0.0, 0.0)
    texts = spark.createDataFrame([(None, None), ("", "a"), ("a b", "a b")], "p string, t string")
    assert scoring.corpus_bleu(texts, F.col("p"), F.col("t"), 1).first().bleu == pytest.approx(np.exp(1 - 3 / 2))
    assert [r.r for r in texts.select(records.row_label("x", F.col("p")).alias("r")).collect()] == ["[x] unknown", "[x] ", "[x] a b"]
    images = spark.createDataFrame([(1, "g", 0, [1.0]), (2, "h", 15, [2.0]), (3, "h", -1, [2.0]), (4, "h", 1, [40.0]), (5, "g", 0, [1.0])], "id int, g string, bits long, means array<double>")
    assert [tuple(r) for r in pairing.near_images(images, "id", "g", "bits", "means").collect()] == [(1, 2, 4)]


def test_samples_wherever_their_members_stand(spark, tmp_path):
    from lakeloom.sources import tar

    (tmp_path / "a.tar").write_bytes(_tar({"k1.txt": b"old", "k2.txt": b"two", "k1.head.jpg": b"h"}))
    (tmp_path / "b.tar").write_bytes(_tar({"k1.txt": b"new"}))
    rows = tar.read_samples(spark, f"file://{tmp_path}", suffixes=("head.jpg",)).cache()
    merged = {r.key: {k: bytes(v) for k, v in r.parts.items()} for r in tar.merged_samples(rows).collect()}
    assert merged == {"k1": {"txt": b"new", "head.jpg": b"h"}, "k2": {"txt": b"two"}}
    assert {(r.shard, r.key, r.bytes) for r in tar.sampled_lengths(rows, 1).collect()} == {("a.tar", "k1", 3), ("b.tar", "k1", 3)}
    asked = tmp_path / "asked"
    asked.mkdir()
    (asked / "q.tar").write_bytes(_tar({"1.ts.npy": b"x", "1.text": b"Question: why? Answer: so Answer: on", "2.text": b"alone"}))
    assert [(r.key, bytes(r.series), r.question, r.answer) for r in tar.question_samples(spark, f"file://{asked}").collect()] == [("1", b"x", "why?", "so Answer: on")]
    shards = spark.createDataFrame([("s-1.tar", 3, 30), ("s-0.tar", 5, 50)], "shard string, samples long, bytes long")
    got = tar.shard_manifest(shards, "d", spark.createDataFrame([("x", 8)], "source string, n long")).first()
    assert (got.num_shards, got.total_samples, got.source_counts) == (2, 8, '{"x":8}') and got.shards.startswith('[{"name":"s-0.tar"')


def test_a_log_is_appended_once(spark, tmp_path):
    from lakeloom.streaming.logs import append_log

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text('{"i": 1}\n{"i": 2}\nbroken\n')
    for _ in range(2):  # a second call finds nothing new
        append_log(spark, f"file://{source}", f"file://{tmp_path}/log", f"file://{tmp_path}/log-c", "i long")
        assert sorted(r.i for r in spark.read.parquet(f"file://{tmp_path}/log").collect()) == [1, 2]


def test_modality_and_file_time(spark, tmp_path):
    df = spark.createDataFrame([("Image",), (None,), ("text",)], "m string")
    assert [r.m for r in df.where(rules.in_modalities(F.col("m"), ["image"])).collect()] == ["Image"]
    assert df.where(rules.in_modalities(F.col("m"), [])).count() == 3
    (tmp_path / "a.json").write_text('{"s": "x"}\n{"s": "y"}\n')
    rows = spark.read.schema("s string").json(f"file://{tmp_path}")
    assert [r.s for r in rules.changed_since(rows, F.lit("2000-01-01").cast("timestamp"), "s", "x").collect()] == ["x"]
    assert rules.changed_since(rows, F.lit("2999-01-01").cast("timestamp")).count() == 0


def test_bag_overlaps_against_counters():
    import random
    from collections import Counter

    import pandas as pd

    rng = random.Random(6)
    lists = [[[rng.choice("abcdeé") for _ in range(rng.randrange(12))] for _ in range(60)] for _ in range(2)]
    got = scoring.bag_overlaps(*map(pd.Series, lists), 4)
    grams = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    assert got.tolist() == [[(grams(a, n) & grams(b, n)).total() for n in range(1, 5)] for a, b in zip(*lists, strict=True)]
    assert scoring.bag_overlaps(pd.Series([[], []]), pd.Series([["a"], []]), 2).tolist() == [[0, 0], [0, 0]]


def test_samples_of_shards_without_a_number(spark):
    df = spark.createDataFrame([("a", 5, 100, 4), ("b", None, 103, 4), ("c", None, None, None), ("d", None, 2, 9)], "name string, samples int, total int, shards int")
    assert {r.name: r.samples for r in manifests.staged_samples(df, "samples", "total", "shards").collect()} == {"a": 5, "b": 25, "c": 1, "d": 1}


def test_series_of_records(spark):
    many = [float(k) for k in range(12)]
    rows = [("[1, 2.5]", None, None, None, [1.0, 2.5]), (None, "[3]", many, "###9###", [3.0]), ("words", "[3]", many, None, many), (None, None, many[:10], "### 4 ###5", [4.0, 5.0]), (None, None, None, "###4 five", None), ("[]", None, None, "no marks 7", None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, v array<double>, t string, want array<double>")
    got = df.select("want", records.series_values([F.col("a"), F.col("b")], [F.col("v")], F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_shared_grams_are_counted_in_runs_of_rows(spark, monkeypatch):
    """A batch is cut by its words, so that what is counted at once does not grow with the batch."""
    assert list(scoring._runs(np.array([3, 4, 90, 0, 0, 5, 6]), 10)) == [(0, 2), (2, 3), (3, 6), (6, 7)]
    assert list(scoring._runs(np.array([], dtype=np.int64), 10)) == []
    rng, most = np.random.default_rng(5), []
    lists = [pa.array([[str(w) for w in rng.integers(0, 6, rng.integers(0, 30))] for _ in range(200)]) for _ in range(2)]
    count = scoring.bag_overlaps
    whole = count(*lists, 3)
    monkeypatch.setattr(scoring, "WORDS", 100)
    monkeypatch.setattr(scoring, "bag_overlaps", lambda x, y, order: most.append(len(x.flatten()) + len(y.flatten())) or count(x, y, order))
    got = next(scoring._shared_grams.func(iter([(*lists, pa.array([3] * 200))])))
    assert got.to_pylist() == whole.tolist() and len(most) > 20 and max(most) <= 100
    none = spark.range(0).select(scoring.shared_grams(F.array(F.lit("a")), F.array(F.lit("a")), 2).alias("n"))
    assert none.collect() == []
