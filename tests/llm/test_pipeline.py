"""The corpus pipeline against the same steps worked out in plain Python from what each stage is given."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm.common import table
from lakeloom.llm.mixing import mix_sources

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.saved(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality", "near_dedup", "mix", "tokens"]
    assert all(after.columns == before.columns for _, before, after in stages[:-1])


def test_quality_drops_junk(spark, stages):
    _, before, after = stages[0]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in after.collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and sum((i in kept) == bool(labels[i]) for i in held) >= 0.9 * len(held)
    assert after.count() < before.count()


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    rows = {r.doc_id: r.text for r in before.collect()}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(rows)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in after.collect()) == [i for i in ids if root(i) == i]


def test_rows_of_one_id_are_decided_on_by_their_texts(spark):
    a, b, x = (" ".join(f"{c}{k}" for k in range(60)) for c in "abx")
    near, nearer = x + " more", "less " + x
    rows = [
        (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, None, None, None, None), (5, near, "en", "s", 1), (3, x, "en", "s", 1),  # unlike texts, a null one and a near copy of another id
        (7, "c " + a, "en", "s", 1), (6, b.upper(), "en", "s", 1),  # near and equal copies
        (None, a, "en", "s", 1), (8, " \t\x0b", "en", "s", 1), (8, "", "en", "s", 1),  # no part in it
        (3, x, "en", "s", 1), (3, x, "de", "s", 1), (3, nearer, "en", "s", 1),  # of one id: copies, another column, a near copy
    ]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema).repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    of_three = [r for r in got if r[0] == 3]
    assert len(of_three) == 1 and of_three[0] in [(3, x, "de", "s", 1), (3, nearer, "en", "s", 1)]
    assert sorted((r for r in got if r[0] != 3), key=str) == sorted([rows[0], rows[1], rows[2], *rows[7:10]], key=str)


def test_mix_takes_what_the_operator_says(stages):
    _, before, after = stages[2]
    due = {r.doc_id: r.copies for r in mix_sources(before).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == due


def test_tokens(stages):
    _, before, after = stages[3]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in before.collect():
        ids = library.encode_ordinary(r.text or "")
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in after.collect()) == sorted(expected)


def test_stages_take_empty_and_odd_tables(spark):
    schema = table(spark, SF, "documents").schema
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], schema)
    # empty texts get one decision, are near copies of nothing, are never mixed in, and have no ids
    expected = {"quality": {0, 3}, "near_dedup": {3}, "mix": {0}, "tokens": {3}}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
        assert stage(spark, odd, SF).select(F.count(F.lit(1))).first()[0] in expected[name]
