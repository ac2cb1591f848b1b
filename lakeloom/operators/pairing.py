"""Joins of annotations, media, tables and plans, near images by Hamming distance, and batches of ragged rows."""

from __future__ import annotations

import math
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.text import stripped
from lakeloom.operators.matching import base_name
from lakeloom.operators.ordering import sha_share, with_index
from lakeloom.sources.scratch import Scratch


def by_base_name(rows: DataFrame, path: str, media: DataFrame, file: str) -> DataFrame:
    """rows that have a media file of the same base name, with its path as ``local_path`` (the first, of several)."""
    named = media.groupBy(base_name(F.col(file)).alias("_name")).agg(F.min(file).alias("local_path"))
    return rows.withColumn("_name", base_name(F.col(path))).join(named, "_name").drop("_name")


def by_shared_partition(left: DataFrame, right: DataFrame, part: str, key: str) -> DataFrame:
    """The inner join on (part, key); parts that only one side has take no part. Parts are pruned where both lie in
    folders of that name."""
    return left.join(right, [part, key])


def token_context(tokens: DataFrame, networks: DataFrame, metadata: DataFrame, token: str, network: str) -> DataFrame:
    """A row for each token and network, with the network's metadata; tokens and networks that match nothing keep one
    row each, with nulls, and ``matched`` says so."""
    out = tokens.join(networks, token, "left").join(metadata.withColumn("_known", F.lit(True)), network, "left")
    return out.withColumn("matched", F.col("_known").isNotNull()).drop("_known")


def in_all(key: str, *frames: DataFrame) -> DataFrame:
    """The inner join of frames with a row a key."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, key)
    return out


def with_fallback(rows: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the value of ``first`` for their key, else of ``second``; blank values count as none."""
    some = lambda c: F.when(stripped(F.col(c)) != "", F.col(c))
    a, b = first.select(key, F.col(value).alias("_a")), second.select(key, F.col(value).alias("_b"))
    return rows.join(a, key, "left").join(b, key, "left").withColumn(value, F.coalesce(some("_a"), some("_b"))).drop("_a", "_b")


def calibrated(cells: DataFrame, calibration: DataFrame, keys: list[str], expected: str, measured: str, slack: float) -> DataFrame:
    """cells with the measured value for their keys and a status: missing, mismatch (further than ``slack`` times the
    expected value from it) or matched."""
    got = cells.join(calibration.select(*keys, measured), keys, "left")
    off = F.abs(F.col(measured) - F.col(expected)) > slack * F.abs(F.col(expected))
    return got.withColumn("status", F.when(F.col(measured).isNull(), "missing").when(off, "mismatch").otherwise("matched"))


#: Rows that a bucket of near hashes is to have at most, on average, and from where it is divided by further bits.
BUCKET, HOT = 64, 4096
#: Channels whose cells part the colours, and the cells to either side of 0 that a channel has.
CHANNELS, CELLS = 3, (1 << 20) - 2


def _masks(within: list[int], parts: int, chosen: int, weight: list[float] | None = None) -> list[int]:
    """Sets of bits: the bit numbers ``within`` in ``parts`` runs, each combination of ``chosen`` runs as a signed 64-bit
    mask. Runs are equally long, or of about equal sums of the bits' weights."""
    if weight is None:
        runs = [within[len(within) * k // parts : len(within) * (k + 1) // parts] for k in range(parts)]
    else:
        runs = [[] for _ in range(parts)]
        for bit in sorted(within, key=lambda b: -weight[b]):
            min(runs, key=lambda r: (sum(weight[b] for b in r), len(r))).append(bit)
    masks = [sum(1 << bit for run in own for bit in run) for own in combinations(runs, chosen)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _cell(means: str, color: float) -> list[Column]:
    """The colours' cells, a little wider than ``color``, so that those of near colours are the same or neighbours."""
    number = lambda i: F.coalesce(F.get(means, F.lit(i)).cast("double"), F.lit(0.0)) / (color * (1 + 1e-6))
    return [F.floor(F.greatest(F.least(number(i), F.lit(float(CELLS))), F.lit(-float(CELLS)))).cast("long") for i in range(CHANNELS)]


def _packed(cells: list[Column]) -> Column:
    """One number for the cells of all channels."""
    return sum((c * F.lit(1 << 21 * i).cast("long") for i, c in enumerate(cells[1:], 1)), cells[0])


def _spread(classes: DataFrame, bits: str, means: str, color: float) -> tuple[float, int, list[float]]:
    """How many rows a row shares its colours' cell with, on average, the most channels, and the entropy of each bit. One
    pass, one row."""
    ones = [F.sum(F.shiftrightunsigned(F.col(bits), b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)]
    cells = classes.groupBy(_packed(_cell(means, color)).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.max(F.size(means)).alias("channels"), *ones)
    row = cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.max("channels").alias("channels"), *(F.sum(f"b{b}").alias(f"b{b}") for b in range(64))).first()
    shares = [row[f"b{b}"] / row.n if row.n else 0.0 for b in range(64)]
    return (row.squares / row.n if row.n else 0.0), row.channels or 0, [-sum(p * math.log2(p) for p in (q, 1 - q) if p > 0) for q in shares]


def near_pairs(left: DataFrame, right: DataFrame | None, key: str, group: str | None, bits: str, means: str, distance: int = 4, color: float = 12.0) -> DataFrame:
    """(a, b, distance): rows a of ``left`` and b of ``right`` (of left too, if it is None: then a < b, once a pair), of
    different keys and groups, whose 64-bit hashes differ in at most ``distance`` bits and whose mean colours differ by
    less than ``color`` in every channel. Keys, hashes and colours must be there.

    Rows meet by the cells of their first colours, of which neighbours meet, and by runs of bits: hashes cut into
    distance + j runs that near agree in j of them, and j grows with the number of rows in a cell, so that a bucket stays
    small on average. Runs have about equal entropy, as bits that hardly vary tell nothing apart. A crowded bucket's rows
    are divided again, by runs of their remaining bits, which near hashes share one of too. A pair is put out where it
    first meets."""
    own, other = [c for c in (group,) if c], left if right is None else right
    crowd, channels, weight = _spread(other, bits, means, color)
    j = 1
    while j < 4 and crowd > BUCKET * 2 ** (64 * j / (distance + j)):
        j += 1
    masks = _masks(list(range(64)), distance + j, j, weight)
    rest = [_masks([b for b in range(64) if not (m >> b) & 1], distance + 1, 1, weight) for m in masks]
    array = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))

    # joins are merged, as sides that grow from small files must not be gathered by the driver, nor pairs by few tasks
    def side(rows: DataFrame, s: str, cell: Column) -> DataFrame:
        named = rows.select(cell.alias("_c"), *(F.col(c).alias(f"{s}_{n}") for c, n in ((bits, "bits"), (means, "means"), (key, "key"), *((c, "group") for c in own))))
        bands = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"{s}_bits").bitwiseAND(F.lit(m).cast("long")).alias("v")) for k, m in enumerate(masks)))
        return named.select("*", F.explode(bands).alias("_b")).select("*", "_b.k", "_b.v").drop("_b")

    x = side(left, "x", _packed(_cell(means, color))).withColumnRenamed("_c", "c")
    steps = [d for d in product((-1, 0, 1), repeat=CHANNELS) if right is not None or d[::-1] >= (0,) * CHANNELS]
    around = F.array(*(F.lit(sum(step << 21 * i for i, step in enumerate(d))).cast("long") for d in steps))
    y = side(other, "y", _packed(_cell(means, color))).withColumn("_d", F.explode(around)).withColumn("c", F.col("_c") + F.col("_d")).drop("_c")
    crowded = Scratch(left.sparkSession).saved(x.groupBy("k", "v", "c").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select("k", "v", "c", F.lit(True).alias("_hot")))
    apart = F.col("x_bits").bitwiseXOR(F.col("y_bits"))

    def first_of(found: list[Column]) -> Column:
        """The number of the first that holds."""
        out = F.when(found[0], 0)
        for n, c in enumerate(found[1:], 1):
            out = out.when(c, n)
        return out

    # no function over arrays, which would leave the join without compiled code
    same = F.size("x_means") == F.size("y_means")
    for i in range(channels):
        same = same & ((F.size("x_means") <= i) | (F.abs(F.get("x_means", F.lit(i)) - F.get("y_means", F.lit(i))) < color))
    ordered = F.col("x_key") != F.col("y_key") if right is not None else (F.col("x_key") < F.col("y_key")) | ((F.col("_d") != 0) & (F.col("x_key") != F.col("y_key")))
    near = (F.bit_count(apart) <= distance) & ordered & (F.col("x_group") != F.col("y_group") if own else F.lit(True)) & F.coalesce(same, F.lit(False))
    near = near & (F.col("k") == first_of([apart.bitwiseAND(F.lit(m).cast("long")) == 0 for m in masks]))
    ends = [F.col("x_key").alias("a"), F.col("y_key").alias("b")] if right is not None else [F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b")]
    out = [*ends, F.bit_count(apart).alias("distance")]
    if crowded.isEmpty():
        return x.join(y.hint("merge"), ["c", "v", "k"]).where(near).select(*out)
    runs = lambda s: F.transform(F.array(*map(array, rest))[F.col("k")], lambda m, n: F.struct(n.alias("s"), F.col(f"{s}_bits").bitwiseAND(m).alias("u")))
    hot = lambda rows, s: rows.join(crowded, ["c", "v", "k"], "left_semi").select("*", F.explode(runs(s)).alias("_i")).select("*", "_i.s", "_i.u").drop("_i")
    calm = x.join(crowded, ["c", "v", "k"], "left_anti").join(y.hint("merge"), ["c", "v", "k"]).where(near).select(*out)
    inner = F.array(*map(array, rest))[F.col("k")]
    again = F.col("s") == first_of([apart.bitwiseAND(inner[n]) == 0 for n in range(distance + 1)])
    return calm.unionByName(hot(x, "x").join(hot(y, "y").hint("merge"), ["c", "v", "k", "s", "u"]).where(near & again).select(*out))


def near_images(df: DataFrame, key: str, group: str | None, bits: str, means: str, distance: int = 4, color: float = 12.0) -> DataFrame:
    """(a, b, distance): pairs of rows of different groups (of all rows, if group is None) whose 64-bit hashes differ in at
    most ``distance`` bits and whose mean colours differ by less than ``color`` in every channel, as near_pairs() finds them.

    Rows with the same group, hash and colours meet others as one, that with the least key. Null hashes and colours have
    no partners."""
    own = [c for c in (group,) if c]
    classes = df.groupBy(*own, bits, means).agg(F.min(key).alias("_key")).where(F.col(bits).isNotNull() & F.col(means).isNotNull())
    return near_pairs(Scratch(df.sparkSession).saved(classes), None, "_key", group, bits, means, distance, color)


def first_plans(*plans: DataFrame, key: str) -> DataFrame:
    """The rows of all plans; of those with one key, the row of the first plan that has it."""
    out = plans[0]
    for other in plans[1:]:
        out = out.unionByName(other.join(out.select(key), key, "left_anti").select(out.columns))
    return out


def uncovered(catalogue: DataFrame, loaded: DataFrame, name: str, skip: str) -> DataFrame:
    """Active datasets of a catalogue that were not loaded."""
    return catalogue.where(~F.coalesce(F.col(skip), F.lit(False))).select(name).join(loaded.select(name), name, "left_anti")


# ---- batches and shards ------------------------------------------------------------------------------------------


def padded_batches(df: DataFrame, index: str, values: str, size: int, most: int, pad: int = 0) -> DataFrame:
    """batch, ids, mask, lengths, width: runs of ``size`` rows, each cut to ``most`` values and filled with ``pad`` up to
    the batch's longest; the mask tells values from filling, also where a value equals ``pad``."""
    cut = df.select(F.floor(F.col(index) / size).cast("long").alias("batch"), F.col(index).alias("i"), F.slice(values, 1, most).alias("v"))
    rows = cut.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("rows"), F.max(F.size("v")).alias("width"))  # ``size`` rows
    fill = lambda x, f, with_: F.concat(f(x["v"]), F.array_repeat(F.lit(with_), F.col("width") - F.size(x["v"])))
    return rows.select("batch", F.transform("rows", lambda x: fill(x, lambda v: v, pad)).alias("ids"), F.transform("rows", lambda x: fill(x, lambda v: F.transform(v, lambda _: F.lit(1)), 0)).alias("mask"), F.transform("rows", lambda x: F.size(x["v"])).alias("lengths"), "width")


def skipped(df: DataFrame, offset: int, *order: str) -> DataFrame:
    """What a run goes on with after ``offset`` rows in the order of columns (the first a number)."""
    return with_index(df, *order, name="_at").where(F.col("_at") >= offset).drop("_at")


def shuffled_blocks(df: DataFrame, index: str, block: int, seed: int) -> DataFrame:
    """Adds place: the order in which a shuffle buffer of ``block`` rows hands rows out: runs of ``block`` rows, each in
    the order of a seeded hash of its indexes."""
    at = F.floor(F.col(index) / block).cast("long")
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(sha_share(F.col(index), seed), index)) - 1
    return df.withColumn("_block", at).withColumn("place", (F.col("_block") * block + rank).cast("long")).drop("_block")


def assigned_shards(shards: DataFrame, dataset: str, name: str, nodes: int, seed: int, per_dataset: int | None = None, per_node: int | None = None) -> DataFrame:
    """dataset, name, node, place: each dataset's shards in a seeded order, dealt to nodes in turn, at most
    ``per_dataset`` of a dataset and ``per_node`` in all to a node. One row a shard."""
    own = Window.partitionBy(dataset).orderBy(sha_share(F.concat_ws(":", dataset, name), seed), name)
    rows = shards.withColumn("_k", F.row_number().over(own) - 1).withColumn("node", (F.col("_k") % nodes).cast("int"))
    if per_dataset is not None:
        rows = rows.where(F.floor(F.col("_k") / nodes) < per_dataset)
    on_node = Window.partitionBy("node").orderBy(sha_share(F.concat_ws(":", F.col("node").cast("string"), dataset, name), seed + 1), dataset, name)
    rows = rows.withColumn("place", (F.row_number().over(on_node) - 1).cast("long"))
    return (rows if per_node is None else rows.where(F.col("place") < per_node)).select(dataset, name, "node", "place")


def continued_index(df: DataFrame, part: str, *order: str, start: int = 0) -> DataFrame:
    """Adds idx: parts one after the other, in ascending order, rows of a part by columns ``order``."""
    out = with_index(df, part, *order)
    return out.withColumn("idx", F.col("idx") + start)


def exact_split(df: DataFrame, share: Column, key: str, ratio: float, last: bool = True) -> DataFrame:
    """Adds split: of n rows in the order of ``share`` (a seeded number a row), floor(n * ratio) are val: the last, or
    the first; the others train."""
    n = df.count()
    val = int(n * ratio)
    placed = with_index(df.withColumn("_share", share), "_share", key, name="_at")
    return placed.withColumn("split", F.when((F.col("_at") >= n - val) if last else (F.col("_at") < val), "val").otherwise("train")).drop("_share", "_at")
