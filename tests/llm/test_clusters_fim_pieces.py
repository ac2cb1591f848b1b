"""Operators 11 to 13 against plain Python and the library: all edge cases, ties, long texts, and models as a whole."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F

from lakeloom.llm.centroid_clusters import Centroids, centroid_clusters
from lakeloom.llm.fill_in_middle import UNIT, fill_in_middle, restored, restored_text
from lakeloom.llm.piece_bpe import PieceEncoder, merged, piece_decode, piece_encode, read_model

PIECES = public_tokenizers.path("piece_bpe_32k.model")
CLASHING = ("id", "row", "v", "n", "ids", "cluster", "distance", "form", "made", "decoded", "sums", "h", "w")


def clashing(df):
    return df.select("*", *(F.lit(1).alias(c) for c in CLASHING))


# ---- operator 11 -------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dims, scale, seed=1):
    """(id, cluster, distance, cluster inertia, inertia, digest) of each kept row, in Python's own integers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(((digest(i), v) for i, v in kept))[:k]]
    for turn in range(rounds + 1):
        found = []
        for _, v in kept:
            found.append(min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)))
        if turn < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = {n: sum(d for d, c in found if c == n) for n in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(kept, found, strict=True)]


def key(row):
    return repr(tuple(row))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("seed", range(3))
def test_clusters_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, 4)) * 3
    rows = [(int(i), (middle[i % 5] + rng.normal(size=4) * 0.3).tolist()) for i in range(300)]
    rows += [(int(i), [0.25, -0.25, 0.5, 0.0]) for i in range(40)] + rows[:20]  # repeated rows and equal vectors
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (7, None), (8, [1.0, None, 2.0, 3.0]), (9, [1.0, float("nan"), 2.0, 3.0]), (10, [1.0, float("inf"), 2.0, 3.0]), (11, [1.0]), (12, [])]
    got = centroid_clusters(clashing(vectors(spark, rows).repartition(5)), k=7, rounds=3, dims=4).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_clusters(rows, 7, 3, 4, 64.0)))


def test_clusters_of_few_none_and_large_vectors(spark):
    few = [(1, [0.5, 0.5]), (2, [-0.5, 3.0])]
    assert sorted(map(key, centroid_clusters(vectors(spark, few), dims=2).collect())) == sorted(map(key, brute_clusters(few, 16, 3, 2, 64.0)))
    for rows in ([], [(1, None)], [(1, [1.0])]):
        out = centroid_clusters(vectors(spark, rows), dims=2)
        assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    # sums of squares beyond 2^53 and beyond 2^63, whose least distances fit 64 bits all the same
    for size in (1e7, 3e10):
        rows = [(i, [size * (i % 3), size + i / 64]) for i in range(30)]
        assert sorted(map(key, centroid_clusters(vectors(spark, rows), k=30, dims=2).collect())) == sorted(map(key, brute_clusters(rows, 30, 3, 2, 64.0)))
    with pytest.raises(Exception, match="64 bits"):
        centroid_clusters(vectors(spark, [(k, [s * 1e12, 0.0]) for k, s in enumerate((1, 1, 1, -1))]), k=1, dims=2).collect()


def test_annulus_keeps_the_nearest_and_spares_comparisons():
    rng = np.random.default_rng(1)
    points = (rng.normal(size=(200, 6)) * rng.integers(1, 400, size=(200, 1))).astype(np.int64)
    points[50] = points[10]  # a tie of all
    x = np.concatenate([(rng.normal(size=(500, 6)) * rng.integers(1, 400, size=(500, 1))).astype(np.int64), points, -points])
    own = Centroids(points)
    cluster, distance, compared = own.nearest(x)
    exact = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert distance.tolist() == exact.min(axis=1).tolist() and cluster.tolist() == exact.argmin(axis=1).tolist()
    assert compared < 0.7 * exact.size


def test_annulus_with_ties_on_its_border():
    """Centroids on a line from the origin: a vector half-way meets both at the very border of its annulus."""
    points = np.array([[2 * k, 0] for k in range(50)][::-1])
    x = np.array([[2 * k + 1, 0] for k in range(49)])
    cluster, distance, _ = Centroids(points).nearest(x)
    assert distance.tolist() == [1] * 49 and cluster.tolist() == [48 - k for k in range(49)]


# ---- operator 12 -------------------------------------------------------------------------------------------------

LONG = " ".join(f"wörd{k % 977} of,\n {k}" for k in range(60_000))
TEXTS = [
    (1, "the quick brown fox\n jumps  "), (1, "the quick brown fox\n jumps  "), (2, ""), (3, None), (None, "no id at all"), (None, None), (4, " \t\n "), (5, "one"), (6, LONG), (7, "has <P> in it"), (8, "has <S>"), (9, "<M>"),
    (10, "x" * 300_000), (11, " " * 300_000), (12, "Ünï côdé 🙂   日本語 é"), *((k, f"word{k} and more of them, " * (k % 5)) for k in range(20, 220)),
]


def brute_fim(doc_id, text):
    text = text or ""
    units = regex.findall(UNIT, text)
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_plain_python(spark):
    docs = clashing(spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3))
    got = fill_in_middle(docs).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *made, sha(made[-1]), sha(t or "")) for i, t in TEXTS for made in [brute_fim(i, t)]]
    assert sorted(map(key, want)) == sorted(key((r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256)) for r in got)
    assert {r.form for r in got} == {"plain", "spm", "psm"} and got[0].row.made == 1
    short = fill_in_middle(docs, keep=["doc_id"], texts=False)
    assert short.where("output is not null").isEmpty() and short.select("row.*").columns == ["doc_id"]
    back = fill_in_middle(docs).select("row.doc_id", restored_text(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(key, back)) == sorted(key((i, t or "")) for i, t in TEXTS)
    assert fill_in_middle(docs.where("false")).collect() == []


def test_restored_of_parts_that_are_empty():
    for prefix in ("", "a "):
        for middle in ("", "b"):
            for suffix in ("", " c\n"):
                assert restored(f"<P>{prefix}<S>{suffix}<M>{middle}", "psm") == prefix + middle + suffix == restored(f"<S>{suffix}<P>{prefix}<M>{middle}", "spm")


# ---- operator 13 -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(read_model(PIECES), memo=500)  # forgets often


def agree(encoder, library, text):
    ids = np.frombuffer(encoder.encode(text), dtype="<i4")
    assert ids.tolist() == library.encode(text), text[:200]
    assert encoder.decode(ids).decode() == library.decode(ids.tolist()), text[:200]


def test_pieces_of_odd_texts(encoder, library):
    for text in ("", " ", "   a  b ", "\n", "a\r\nb\tc", "▁x", "▁▁ x▁", "<s> <0x0A> <unk>", "日本語 テスト🙂 é", "\x00a\x00", "ÇA Größe 한국어", "⁇ x", "﻿ x", "�", "...!?", "U.S.A.,", "it's"):
        agree(encoder, library, text)
    for n in (1, 15, 16, 17, 33, 1000, 100_000):
        for part in (" ", "a", "ab", "-", ".", "the", "0", "日", "🙂", "\n", "▁a"):
            agree(encoder, library, part * n)
    agree(encoder, library, LONG)


def test_pieces_of_random_texts(encoder, library):
    rng, own = random.Random(2), read_model(PIECES).pieces[259:]
    for _ in range(3000):
        parts = [rng.choice(own) if rng.random() < 0.7 else chr(rng.choice([rng.randint(0, 127), rng.randint(128, 0x2FFF), rng.randint(0x4E00, 0x9FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 14))]
        agree(encoder, library, "".join(parts).replace("▁", rng.choice(" ▁")))
    for _ in range(1000):
        agree(encoder, library, "".join(rng.choice("aeinstrhl  .0") for _ in range(rng.randint(1, 200))))


def test_every_prefix_has_the_last_token_of_its_own_merges(encoder):
    rng = random.Random(3)
    for _ in range(200):
        text = "▁" + "".join(rng.choice("aeinstrhlo") for _ in range(30))
        last = encoder.last_tokens(text)
        assert [encoder.tokens[t] for t in last[1:]] == [merged(text[:k], encoder.score)[-1] for k in range(1, len(text) + 1)]


def test_decoding_any_ids(encoder, library):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.randint(1, 9))]
        assert encoder.decode(np.array(ids)).decode() == library.decode(ids), ids


def test_pieces_on_spark(spark, library):
    docs = clashing(spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3))
    out = piece_encode(docs, PIECES, decode=True)
    got = out.collect()
    want = [(i, library.encode(t or "")) for i, t in TEXTS]
    assert sorted(map(key, ((r.row.doc_id, r.ids) for r in got))) == sorted(map(key, want))
    assert all(r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids) and r.row.n == 1 for r in got)
    assert piece_encode(docs.where("false"), PIECES).collect() == []
    again = piece_decode(out.select("ids", "decoded").withColumnRenamed("decoded", "was"), PIECES).collect()
    assert all(r.was == r.decoded for r in again)


def test_models_of_other_kinds_are_refused(tmp_path):
    raw = open(PIECES, "rb").read()
    path = tmp_path / "other.model"
    path.write_bytes(raw + bytes([(2 << 3) | 2, 2, 3 << 3, 1]))  # a later trainer field: the unigram kind
    with pytest.raises(ValueError, match="BPE"):
        read_model(str(path))
