"""Greedy selection against a sequential pass, and near hashes against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import pairing, selection


def sequential(n, members, pairs):
    keys, before, used, taken = {}, {}, set(), set()
    for i, k in members:
        keys.setdefault(i, set()).add(k)
    for a, b in pairs:
        before.setdefault(max(a, b), set()).add(min(a, b))
    for i in range(n):
        if not used & keys.get(i, set()) and not taken & (before.get(i, set()) - {i}):
            taken.add(i)
            used |= keys.get(i, set())
    return sorted(taken)


def run(spark, n, members, pairs, **how):
    nodes = spark.range(n).withColumnRenamed("id", "i").repartition(3)
    m = spark.createDataFrame(members, "i long, key string")
    p = spark.createDataFrame(pairs, "a long, b long")
    return sorted(r.i for r in selection.first_independent(nodes, m, p, **how).collect())


@pytest.mark.parametrize(("seed", "component"), [(0, 200_000), (1, 10)])
def test_random_graphs(spark, seed, component):
    rng, n = random.Random(seed), 150
    members = [(rng.randrange(n), f"k{rng.randrange(60)}") for _ in range(120)] + [(k, "hot") for k in range(40, 90)] + [(3, None)]
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(120)] + [(5, 5), (5, 10**6)]
    assert run(spark, n, members, pairs, rounds=2, component=component) == sequential(n, [m for m in members if m[1]], [p for p in pairs if p[1] < n])


def test_a_long_chain(spark):
    """Each row conflicts with the next: every other one is taken, which no few rounds can find."""
    n = 3000
    assert run(spark, n, [], [(k, k + 1) for k in range(n - 1)], rounds=1) == list(range(0, n, 2))


def test_reasons_counts_and_cuts(spark):
    rows = [(1, "a", "p1", None), (2, "a", "p2", None), (3, "b", "p1", None), (4, None, "p4", "words"), (5, "c", "p5", None), (6, "d", "p6", None), (7, "e", "p7", None), (8, "a", "p1", None), (9, "f", None, None)]
    df = spark.createDataFrame(rows, "id long, g string, pixels string, why string")
    pairs = spark.createDataFrame([(6, 5), (7, 4), (8, 5)], "a long, b long")
    keys = {"group": F.array("g"), "pixel": F.col("pixels")}
    got = {r.id: (r.taken, r.reason) for r in selection.select_first(df, ["id"], F.col("why"), keys, pairs=("near", pairs)).collect()}
    assert got == {1: (True, None), 2: (False, "group"), 3: (False, "pixel"), 4: (False, "words"), 5: (True, None), 6: (False, "near"), 7: (True, None), 8: (False, "group"), 9: (True, None)}
    cut = selection.select_first(df, ["id"], F.col("why"), keys, pairs=("near", pairs), count=2)
    assert {r.id: r.reason for r in cut.collect()} == {1: None, 2: "group", 3: "pixel", 4: "words", 5: None, 6: "not_reached", 7: "not_reached", 8: "not_reached", 9: "not_reached"}
    assert {r.reason: r.n for r in selection.exclusions(cut).collect()} == {"group": 1, "pixel": 1, "words": 1}
    words = spark.createDataFrame([(1, "x"), (5, "x"), (5, "y"), (9, "y"), (77, "x"), (7, None)], "id long, v string")
    also = selection.select_first(df, ["id"], F.col("why"), keys, {"word": words}, ("near", pairs))
    assert {r.id: r.reason for r in also.where("not taken").collect()} == {2: "group", 3: "pixel", 4: "words", 5: "word", 8: "group"}
    assert selection.select_first(df.where("false"), ["id"], F.col("why"), keys).collect() == []
    assert [r.taken for r in selection.select_first(df, ["id"], F.lit(None).cast("string"), {}).collect()] == [True] * 9


def near_by_all_pairs(rows, distance=4, color=12.0, grouped=True):
    classes = {}
    for key, group, bits, means in rows:
        if bits is not None and means is not None:
            own = (group if grouped else None, bits, tuple(means))
            classes[own] = min(key, classes.get(own, key))
    flat = [(k, *own) for own, k in classes.items()]
    out = set()
    for a in flat:
        for b in flat:
            apart = bin((a[2] ^ b[2]) & (2**64 - 1)).count("1")
            if a[0] < b[0] and (not grouped or a[1] != b[1]) and apart <= distance and all(abs(x - y) < color for x, y in zip(a[3], b[3], strict=True)):
                out.add((a[0], b[0], apart))
    return out


@pytest.mark.parametrize(("bucket", "hot"), [(64, 4096), (0.001, 4096), (64, 5), (0.01, 3)])
def test_near_hashes_against_all_pairs(spark, monkeypatch, bucket, hot):
    """Also with more runs than two, and with every bucket crowded."""
    monkeypatch.setattr(pairing, "BUCKET", bucket)
    monkeypatch.setattr(pairing, "HOT", hot)
    rng = random.Random(7)
    centers = [rng.getrandbits(64) for _ in range(6)] + [0, 2**63]
    rows = []
    for k in range(160):
        bits = rng.choice(centers)
        for _ in range(rng.randrange(5)):
            bits ^= 1 << rng.randrange(64)
        rows.append((k, rng.choice("ab"), bits - (1 << 64) if bits >= 1 << 63 else bits, [rng.choice([0.0, 11.9, 12.0, 30.0]), 5.0]))
    rows += [(k + 200, "c", 0, [0.0, 5.0]) for k in range(5)] + [(300, "a", None, [1.0]), (301, "b", 0, None)]
    df = spark.createDataFrame(rows, "id long, g string, bits long, means array<double>")
    assert {tuple(r) for r in pairing.near_images(df, "id", "g", "bits", "means").collect()} == near_by_all_pairs(rows)
    if bucket == 64:
        assert {tuple(r) for r in pairing.near_images(df, "id", None, "bits", "means").collect()} == near_by_all_pairs(rows, grouped=False)


def test_masks_cover_every_near_pair():
    for j in range(1, 5):
        masks = pairing._masks(list(range(64)), 4 + j, j)
        for _ in range(200):
            x = sum(1 << b for b in random.sample(range(64), 4))
            assert any(m & x == 0 for m in masks)


@pytest.mark.parametrize(("block", "seed"), [(8192, 0), (20, 1), (5, 2), (1, 3)])
def test_blocks_of_near_classes_against_a_sequential_pass(spark, block, seed):
    """What a block takes falls upon the rows behind it: by keys, by classes and by near ones; rows without a class too."""
    rng, n = random.Random(seed), 120
    classes = {i: rng.choice([None, *range(40)]) for i in range(n)}
    members = [(rng.randrange(n), f"k{rng.randrange(50)}") for _ in range(60)]
    links = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
    table = spark.createDataFrame([(a, b) for a, b in links] + [(b, a) for a, b in links], "a long, b long")

    def near(left, right):
        asked = table.join(left.withColumnRenamed("c", "a"), "a", "left_semi").join((left if right is None else right).withColumnRenamed("c", "b"), "b", "left_semi")
        return asked.where("a < b") if right is None else asked

    of = lambda i: classes[i] is not None
    apart = lambda i, j: not (of(i) and of(j) and (classes[i] == classes[j] or tuple(sorted((classes[i], classes[j]))) in links))
    pairs = [(i, j) for i in range(n) for j in range(i) if not apart(i, j)]
    nodes = spark.createDataFrame(list(classes.items()), "i long, c long")
    got = selection.first_apart(nodes, spark.createDataFrame(members, "i long, key string"), near, block)
    assert sorted(r.i for r in got.collect()) == sequential(n, members, pairs)


def test_near_pairs_of_two_tables_and_their_plan(spark):
    """Each pair once, whatever the cells' borders; no side is gathered, however small its files are."""
    rng = random.Random(3)
    rows = [(k, rng.choice([0, 255, -1]) ^ (1 << rng.randrange(62)), [rng.choice([-12.0, -0.5, 0.0, 11.9, 12.0, 1e300]), rng.uniform(-30, 30)]) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, bits long, means array<double>")
    every = near_by_all_pairs([(k, None, b, m) for k, b, m in rows], grouped=False)
    got = [tuple(r) for r in pairing.near_pairs(df.where("id < 40"), df.where("id >= 40"), "id", None, "bits", "means").collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p in every if p[0] < 40 <= p[1]}
    met = pairing.near_pairs(df, None, "id", None, "bits", "means")
    assert len(met.collect()) == len(every) > 20
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
