"""Edge cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeloom.llm.byte_bpe import bpe_decode, bpe_encode
from lakeloom.llm.exact_topk import exact_topk
from lakeloom.llm.html_text import extract_text
from lakeloom.llm.license_scan import scan_licenses
from lakeloom.llm.media import read_media, store_media
from lakeloom.llm.mixing import mix_sources, mixed_documents
from lakeloom.llm.near_dedup import near_duplicates
from lakeloom.llm.quality_crf import score_quality, train_quality
from lakeloom.llm.token_files import token_table
from lakeloom.llm.warc import read_warc_chunks, records, warc_round_trip, write_warc

BPE, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{k % 977} of, {k}" for k in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "a"),
    (3, None, None),
    (4, "", "b"),
    (5, "   \n\t ", "b"),
    (None, "Größe ÇA é́ 日本語 🙂 it's MIT License", None),
    (None, None, "a"),
    (6, LONG, "b"),
    (7, "single", "\U0001f642"),
    (8, "Released under the MIT License.\nGNU General Public License, version 3", "ä"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with columns whose names clash with those the operators use."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select("doc_id", "text", "source", *(F.lit(1).alias(c) for c in ("id", "row", "score", "size", "n", "cls", "band", "ids", "label", "copies")))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_near_duplicates(docs, none):
    got = near_duplicates(docs, words=2, percent=80).collect()
    assert len(got) == len(ROWS)
    of = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert of[1] == (11, 1, True) and of[2] == (11, 1, False)
    assert of[3] == (0, 3, True) and of[4] == (0, 4, True) and of[5] == (0, 5, True) and of[7] == (1, 7, True)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert near_duplicates(none).collect() == []


def test_near_duplicates_against_brute_force(spark):
    """A chain of edits, a large group of near copies round one text, and unrelated texts: exact components."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 5000, 90)]
    texts = []
    for k in range(150):
        own = list(base)
        for at in rng.integers(0, len(own), int(rng.integers(0, 12))):
            own[at] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(own))
    chain = [f"c{k}" for k in range(60)]
    for k in range(0, 60, 3):
        chain[k] = f"y{k}"
        texts.append(" ".join(chain))
    texts += [" ".join(f"z{x}" for x in rng.integers(0, 50, 30)) for _ in range(30)]
    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:], strict=False)} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near_duplicates(df, words=2, percent=80).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def test_licenses(docs, none):
    got = {(r.doc_id, r.labels, r.n_base, r.first_word, r.last_word, r.score) for r in scan_licenses(docs).collect()}
    assert (8, "gpl,mit,mit-notice", 2, 3, 6, 1.0) in got
    assert (None, "mit", 1, 7, 7, 0.5) in got
    assert (3, "", 0, None, None, 0.0) in got
    assert scan_licenses(none).collect() == []


def test_token_files(spark, docs, none, tmp_path):
    library = Tokenizer.from_file(WORDS)
    folder = f"file://{tmp_path}/tokens"
    got = token_table(docs, WORDS, end_id=1, folder=folder).collect()
    assert len(got) == len(ROWS)
    order = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in order:
        assert (r.start, len(r.ids)) == (at, 4 * r.n_tokens)
        at += r.n_tokens
    expected = sorted((i is not None, i or 0, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for i, t, _ in ROWS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == expected
    assert any(f.endswith(".tok") for f in os.listdir(tmp_path / "tokens"))
    assert token_table(none, WORDS, end_id=1, folder=f"file://{tmp_path}/none").collect() == []


def test_mixing(docs, none):
    got = mix_sources(docs).collect()
    assert len(got) == len(ROWS)
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in got)
    totals = {(r.source_size, round(r.target, 6)) for r in got}
    assert all(t <= 2 * s + 1e-6 for s, t in totals)
    assert got == mix_sources(docs).collect()
    assert mix_sources(none).collect() == []
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_mixing_comes_near_targets(spark):
    df = spark.range(4000).selectExpr("id doc_id", "concat('s', id % 4) source", "repeat('w ', cast(1 + id % 97 as int)) text")
    got = mix_sources(df)
    for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert r.target - 100 <= r.taken <= r.target


def test_mixing_takes_some_of_tied_rows(spark):
    df = spark.range(900).selectExpr("cast(null as long) doc_id", "element_at(array('a', 'b', null), cast(1 + id % 3 as int)) source", "'one two three four five' text")
    taken = {(r.source_size, r.target, r.copies): r.n for r in mix_sources(df).groupBy("source_size", "target", "copies").agg(F.count(F.lit(1)).alias("n")).collect()}
    for target in {t for _, t, _ in taken}:
        words = sum(5 * c * n for (_, t, c), n in taken.items() if t == target)
        assert target - 5 < words <= target
    mixed = mixed_documents(df)
    assert mixed.count() == sum(c * n for (_, _, c), n in taken.items())


def test_mixing_takes_the_same_of_tied_rows_in_any_order(spark):
    """Rows of one id and size with unlike texts, some of them alike in all columns: the digest decides, not the place."""
    rows = [(7, f"a{k // 2} b c", "s") for k in range(20)] + [(None, f"n{k} m", "s") for k in range(15)] + [(100 + k, "w " * (1 + k % 5), "t") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    orders = (df.coalesce(1), df.orderBy(F.desc("text")).coalesce(1), df.repartition(6), df.repartition(3, "text"))
    first, *rest = [sorted(map(str, mixed_documents(x).collect())) for x in orders]
    assert all(r == first for r in rest)
    assert len(first) == mix_sources(df).agg(F.sum("copies")).first()[0]


def test_byte_bpe(spark, docs, none):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe_encode(docs, BPE, public_tokenizers.PATTERN, decode=True).collect()
    expected = sorted((i or 0, np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for i, t, _ in ROWS)
    assert sorted((r.doc_id or 0, bytes(r.ids), bytes(r.decoded)) for r in got) == expected
    again = bpe_decode(bpe_encode(docs, BPE, public_tokenizers.PATTERN), BPE).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted((t or "").encode() for _, t, _ in ROWS)
    assert bpe_encode(none, BPE, public_tokenizers.PATTERN).collect() == []


def test_media(docs, none):
    got = read_media(store_media(docs)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        raw = bytes(r.pixels)
        assert len(raw) == r.payload_bytes and len(raw) % 64 == 0 and raw[r.n_bytes :].strip(b"\0") == b""
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.tail_crc32 == zlib.crc32(raw[-64:])
    texts = sorted((t or "").encode() for _, t, _ in ROWS)
    assert sorted(bytes(r.pixels)[: r.n_bytes] for r in got) == texts
    assert len({r.media_sha256 for r in got}) == len(set(texts))
    assert read_media(store_media(none)).collect() == []


def test_topk(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, [float(x) for x in rng.normal(size=40)]) for k in range(600)]
    vectors += [(1000, vectors[5][1]), (1001, vectors[5][1]), (1001, vectors[5][1]), (1002, None), (1003, [1.0, None]), (1004, [float("nan")] * 40), (None, vectors[0][1]), (1100, []), (1200, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("id", F.lit(0)).repartition(3)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk(df, df.where("vec_id % 100 = 0"), k=10).collect()]
    whole = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in vectors[:602]}
    expected = []
    rows = [(i, whole[i]) for i in whole] + [(1001, whole[1001])]
    for q in [k for k in whole if k % 100 == 0]:
        best = sorted((-int(v @ whole[q]), i) for i, v in rows if i != q)[:10]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(expected)
    none = df.where("false")
    assert exact_topk(none, none).collect() == [] and exact_topk(df, none).collect() == []


def test_quality(spark, docs, none):
    good = [(k, f"A plain sentence about number {k} and its friends.\nAnother line that ends well, as lines do.") for k in range(60)]
    bad = [(100 + k, "x x x x x x x x x\n$$$ %%% ### !!! " * (1 + k % 3)) for k in range(60)]
    train = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad] + [(5, None), (None, 1), (999, 0)], "doc_id long, quality int")
    model = train_quality(train, labels)
    scored = score_quality(train, model).select("row.doc_id", "score").collect()
    assert all((r.score >= 0.5) == (r.doc_id < 100) for r in scored)
    got = score_quality(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.row.text}) == 1
    assert score_quality(none, model).collect() == []
    empty = train_quality(train, labels.where("false"))
    assert {r.score for r in score_quality(docs, empty).collect()} == {0.5}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<header><div class="logo">Site</div></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>One &amp;
 two</h1><p><b>First&nbsp;part<br>goes   on.<p>Second &eacute;t&eacute;.</p><div class="ad">Buy this now</div><ul><li>point one here</li><li>point two here</li></ul></article>
<aside class="sidebar"><p>Elsewhere on the site</p></aside><section id="comments"><div class="comment"><p>I disagree with all of it.</p></div></section>
<form><label>Mail</label><input></form><footer>&copy; nobody</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "plain words"), (4, "x", "<p>open <div><<b>a</p></div></nav>"), (5, "y", "<div>" * 3000 + "deep" + "</div>" * 10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract_text(df).select("row.page_id", "text", "n_chars").collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = [r.text for r in got if r.page_id == 1]
    assert texts == ["One & two\nFirst part goes on.\nSecond été.\npoint one here\npoint two here"] * 2
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert extract_text(df.where("false")).collect() == []


def test_warc(spark, tmp_path):
    big, huge = "é" * 600, "z\r\n\r\n" * 300_000
    rows = [(1, "http://a/", big), (7, "http://b/\r\nX: y", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (8, "u", "small"), (None, "n", big), (9, "h", huge), (9, "h", huge)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_round_trip(df).collect()]
    expected = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = 7 if h == big and i != 7 else None
        expected.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to))
    assert sorted(got, key=str) == sorted(expected, key=str)
    files = write_warc(df, f"file://{tmp_path}/w", most=10_000)
    chunks = read_warc_chunks(spark, f"file://{tmp_path}/w", files)
    own = chunks.where("id = 9").orderBy("file", "record", "chunk").collect()
    assert len({(r.file, r.record) for r in own}) == 2 and max(len(r.data) for r in own) <= 1 << 18
    assert b"".join(bytes(r.data) for r in own).decode() == huge * 2
    assert records(chunks).count() == len(rows)
    assert warc_round_trip(df.where("false")).collect() == []
