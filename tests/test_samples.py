"""Sample functions, draws, joins with rules and line files against small cases."""

import hashlib
import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakeloom.functions import samples as S
from lakeloom.functions import similarity
from lakeloom.operators import audit, matching, sampling
from lakeloom.sources import manifests


def one(df, c):
    return df.select(c.alias("v")).first().v


def test_sample_text(spark):
    df = spark.sql("select array(struct('user' as role, 'hi' as content), struct('bot' as role, 'ho' as content)) as two, array(struct('user' as role, 'hi' as content)) as one, cast(null as array<struct<role:string,content:string>>) as none, array(struct(5D as x, 6D as y)) as p, cast(null as array<struct<x:double,y:double>>) as q")
    kind = lambda turns, points, label, text: tuple(one(df, S.sample_text(F.col(turns), F.col(points), F.lit(label), F.lit(text))))
    assert kind("two", "p", "l", "c") == ("user: hi\nbot: ho", "pointing_conversation")
    assert kind("one", "p", "l", "c") == ("c", "caption")
    assert kind("none", "p", "l", "c") == ('<points coords="1 1 50 60">l</points>', "pointing_pixmo")
    assert kind("none", "p", "", " ") == ("An image.", "caption") and kind("none", "q", "l", None) == ("An image.", "caption")


@pytest.mark.parametrize(("text", "found"), [("[1, 2.5]", [1.0, 2.5]), ("1,2", [1.0, 2.0]), ("1 2  3", [1.0, 2.0, 3.0]), ("1\t2", [1.0, 2.0]), ("1;2", [1.0, 2.0]), ("[7]", [7.0]), ("7", None), ("a,b", None), ("", None), (None, None)])
def test_number_list(spark, text, found):
    assert one(spark.createDataFrame([(text,)], "t string"), S.number_list(F.col("t"))) == found


def test_arrays(spark):
    df = spark.sql("select array(array(1D, 2D, 3D), array(4D)) as ragged, array(array(1D, 2D, 3D), array(4D, 5D, 6D)) as wide, array(struct(1 as src, 200 as dst), struct(3 as src, 4 as dst)) as e, array(1.5D) as m, array(0.25D) as s")
    assert one(df, S.rectangle(F.col("ragged"))) == [[1, 2, 3], [4, 0, 0]]
    assert one(df, S.upright(F.col("wide"))) == [[1, 4], [2, 5], [3, 6]]
    assert [tuple(r) for r in one(df, S.kept_edges(F.col("e")))] == [(3, 4)]
    assert one(df, S.with_statistics(F.lit("a<ts>b<ts>c"), F.col("m"), F.col("s"))) == "a<ts> Mean: 1.50, Std: 0.25 b<ts>c"
    assert one(df, S.hamming(F.lit(5).cast("long"), F.lit(6).cast("long"))) == 2


def test_texts(spark):
    df = spark.range(1)
    lit = F.lit
    assert one(df, S.table_text(F.array(lit("h")), F.array(F.array(lit("abcdef")), F.array(lit(None).cast("string"))), 3)) == "h\nabc\n"
    assert one(df, S.motifs(lit("C=C1#"))) == "Double Bond, Triple Bond, Ring" and one(df, S.motifs(lit("C"))) == ""
    assert [one(df, S.repaired_path(lit(p), "/d/")) for p in ("/x", "a/images/b/images/c.png", "a/b.png")] == ["/x", "/d/images/c.png", "/d/b.png"]
    assert one(df, S.first_text(lit(None).cast("string"), lit(" "), lit("t"))) == "t"
    kinds = [one(df, S.image_kind(F.unhex(lit(h)))) for h in ("FFD8FFE0", "89504E470D0A1A0A00", "524946460000000057454250", "00")]
    assert kinds == ["jpg", "png", "webp", None]
    answers = ['{"a": 1}', 'x\n```json\n{"a": 1}\n```', 'so {"a": 1} it is', "{a", "none"]
    assert [one(df, S.loose_json(lit(a))) for a in answers] == ['{"a": 1}'] * 3 + [None, None]
    assert one(df, S.sentences(lit(" One. Two!  Three? v1.2 "))) == ["One.", "Two!", "Three?", "v1.2"]
    assert one(df, S.sentences(lit("A. B. C."), 2)) == ["A.", "B."]
    assert tuple(one(df, S.split_answer(lit("Question: q Answer: a Answer: b")))) == ("q", "a Answer: b")
    assert tuple(one(df, S.split_answer(lit("no mark")))) == ("no mark", None)
    assert one(df, S.choices_text(lit("q"), F.array(lit("x"), lit("y")))) == "Question: q\nA. x\nB. y\nAnswer:"
    assert one(df, S.rendered_turns(F.array(F.struct(lit("user").alias("role"), lit("hi").alias("content"))))) == "<|im_start|>user\nhi<|im_end|>\n"


def test_blocks(spark):
    df = spark.createDataFrame([("a b c d", "a b x d"), (None, "x"), ("", "")], "a string, b string")
    got = [tuple(r) for r in df.select(similarity.block_f1("a", "b"), similarity.ratio("a", "b")).collect()]
    assert got == [(0.75, pytest.approx(12 / 14)), (0.0, 0.0), (0.0, 1.0)]


def test_draws(spark):
    got = sampling.draws(spark, [("a", 3.0, 10), ("b", 1.0, 5)], 4000, 1).collect()
    assert len(got) == 4000 and all(0 <= r.place < {"a": 10, "b": 5}[r.dataset] for r in got)
    assert 0.72 < sum(r.dataset == "a" for r in got) / 4000 < 0.78
    groups = {"g": [("a", 1.0, 3)], "h": [("b", 1.0, 3), ("c", 1.0, 7)]}
    rows = sampling.grouped_draws(spark, groups, 50, 8, 1).collect()
    assert len(rows) == 400 and all(len({r.group for r in rows if r.batch == b}) == 1 for b in range(50))
    assert {(r.group, r.dataset) for r in rows} == {("g", "a"), ("h", "b"), ("h", "c")} and max(r.place for r in rows) <= 6


def test_interleaved_and_prefixes(spark):
    df = spark.range(900).selectExpr("id", "if(id < 600, 'a', 'b') as s")
    got = sampling.interleaved(df, "s", {"a": 4.0}, "id", seed=3).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(900)) and {r.id for r in got} == set(range(900))
    assert sum(r.s == "a" for r in got[:200]) > 140
    short = sampling.interleaved(df, "s", {"a": 4.0}, "id", seed=3, until_first_ends=True).collect()
    assert max(r.idx for r in short) == min(max(r.idx for r in got if r.s == s) for s in "ab")
    few = spark.createDataFrame([(k, "x" if k % 3 else None) for k in range(30)] + [(99, "lone")], "id long, g string")
    kept = sampling.prefix_share(few, "g", 0.25, "id").collect()
    assert sorted((r.g or "", r.id) for r in kept) == [("", 0), ("", 3), ("lone", 99), ("x", 1), ("x", 2), ("x", 4), ("x", 5), ("x", 7)]
    steps = sampling.steps_of(spark.createDataFrame([(7, 2), (3, 3), (5, 0)], "e long, n int"), "e", "n").orderBy("idx").collect()
    assert [tuple(r) for r in steps] == [(0, 3, 0), (1, 3, 1), (2, 3, 2), (3, 7, 0), (4, 7, 1)]


def test_matching(spark):
    files = spark.createDataFrame([("a/1.png", "one"), ("b/2.png", "two"), ("c/2.png", "deux"), ("a/3.png", None)], "file string, v string")
    rows = spark.createDataFrame([("a/1.png",), ("z/2.png",), ("z/9.png",), ("a/3.png",), (None,)], "path string")
    got = {r.path: (r.v, r.how) for r in matching.by_path(rows, "path", files, "file", "v").collect()}
    assert got == {"a/1.png": ("one", "path"), "z/2.png": ("two", "name"), "z/9.png": (None, "none"), "a/3.png": (None, "path"), None: (None, "none")}
    found = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (3, "x"), (3, "y"), (3, "z")], "k long, v string")
    status = {r.k: (r.found, r.v, r.status) for r in matching.resolved(spark.range(1, 5).withColumnRenamed("id", "k"), found, "k", "v", 2).collect()}
    assert status == {1: (1, "a", "resolved"), 2: (2, "a", "resolved"), 3: (3, None, "ambiguous"), 4: (0, None, "unresolved")}
    last = {r.k: r.v for r in matching.with_latest(spark.createDataFrame([(1,), (9,)], "k long"), spark.createDataFrame([(1, 5, "new"), (1, 4, "old")], "k long, at long, v string"), "k", ["at"], ["v"]).collect()}
    assert last == {1: "new", 9: None}
    agreed = matching.agreed(spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0), (3, 1.0)], "k long, v double"), "k", "v", spark.createDataFrame([(1,), (2,), (2,)], "k long"))
    assert sorted(tuple(r) for r in agreed.collect()) == [(1, 2.0, 1), (2, None, 2)]
    grid = matching.complete_grid(spark.createDataFrame([("c",)], "case string"), {"seed": [1, 2], "run": ["x"]}, spark.createDataFrame([("c", 1, "x", 0.5)], "case string, seed int, run string, s double"), "s")
    assert sorted((r.seed, r.s, r.failed) for r in grid.collect()) == [(1, 0.5, False), (2, 0.0, True)]


def test_fingerprint(spark):
    rows = [(1, "a"), (2, None), (2, None)]
    a = audit.fingerprint(spark.createDataFrame(rows, "k long, v string"), ["k", "v"], digits=1).first()
    b = audit.fingerprint(spark.createDataFrame(rows[::-1], "k long, v string").repartition(3), ["k", "v"], digits=1).first()
    assert a == b and a["rows"] == 3
    assert audit.fingerprint(spark.createDataFrame(rows[:2], "k long, v string"), ["k", "v"]).first() != a
    empty = audit.fingerprint(spark.createDataFrame([], "k long"), ["k"]).first()
    assert empty.fingerprint == hashlib.sha256(b"").hexdigest() and empty["rows"] == 0


def test_files(spark, tmp_path):
    logs = tmp_path / "logs"
    for run, lines in (("r1/x", ['{"step": 1}', "broken", '{"step": 2}']), ("r2", ['{"step": 3}'])):
        (logs / run).mkdir(parents=True)
        (logs / run / "perf.jsonl").write_text("\n".join(lines))
    (logs / "manifest.json").write_text(json.dumps({"step": 9}))
    steps = lambda mode: sorted(r.step or 0 for r in manifests.json_lines(spark, f"file://{logs}", "step long", mode).collect())
    assert steps("skip") == [1, 2, 3] and steps("keep") == [0, 1, 2, 3]
    with pytest.raises((PySparkException, Py4JJavaError)):
        steps("strict")
    got = sorted((r.run_dir, r.step) for r in manifests.run_logs(spark, f"file://{logs}", "step long").collect())
    assert got == [("r1/x", 1), ("r1/x", 2), ("r2", 3)]
    (tmp_path / "g.fa").write_text(">chr1 first\nacgt\nNN\n>chr2\nGG\n")
    assert sorted(tuple(r) for r in manifests.fasta(spark, f"file://{tmp_path}/g.fa").collect()) == [("chr1", "ACGTNN"), ("chr2", "GG")]
    (tmp_path / "s.txt").write_text("=== PROMPT ===\np\nq\n=== GROUND TRUTH ===\ng\n")
    row = manifests.sections(spark, f"file://{tmp_path}/s.txt", ["PROMPT", "GROUND TRUTH", "PREDICTION"]).first()
    assert (row.prompt, row.ground_truth, row.prediction) == ("p\nq", "g", None)
    names = manifests.shard_names(spark.createDataFrame([("d", 1, 2), ("e", None, None)], "d string, a int, b int"), "d", "a", "b").collect()
    assert [(r.split, r.name) for r in sorted(names)] == [("train", "d-000000.tar"), ("val", "d-000001.tar"), ("val", "d-000002.tar")]
