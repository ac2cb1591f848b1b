"""Greedy packing of an ordered table into shards, exactly as one sequential pass would do it, but in parallel.

A shard is closed once it has so many bytes or rows, so where the next one begins follows from where it began alone.
Positions thus point at positions, and the shards are the chain from the first. It is found by ranges:

* up: each range of positions folds its own pointers, from the last to the first, so that every position at which the
  chain can enter it (those within one shard's length of its beginning) points at once to the first place behind it;
  runs of ``FAN`` ranges fold these pointers in turn, and so on until one is left,
* down: the chain's entry into a run of ranges gives its entries into these, and at last the shards of each range.

A level has a small share of the rows of the level below; no task holds more than a range or a run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.ordering import with_index

#: Shards' worth of rows in a range, and ranges folded together by a level above.
SPAN, FAN = 64, 64
#: How far the measure of a row can lie above that of the row its shard begins with.
AHEAD = 2
#: Rows whose running sums are found together.
BLOCK = 500_000


def running_sums(df: DataFrame, index: str, block: int = BLOCK, **values: Column) -> DataFrame:
    """Adds each named value's sum over all rows with a smaller ``index`` (a row number from 0), and as ``<name>_last``
    the value of the row before: sums within blocks of rows, and a row a block to add what comes before it."""
    placed = df.withColumn("_block", F.floor(F.col(index) / block).cast("long"))
    blocks = Window.orderBy("_block")  # a row a block
    each = placed.groupBy("_block").agg(*(x for n, v in values.items() for x in (F.sum(v).alias(f"_{n}_all"), F.max_by(v, F.col(index)).alias(f"_{n}_end"))))
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("_block", *(x for n in values for x in (F.coalesce(F.sum(f"_{n}_all").over(before), F.lit(0)).alias(f"_{n}_from"), F.lag(f"_{n}_end").over(blocks).alias(f"_{n}_lag"))))
    inside = Window.partitionBy("_block").orderBy(index)
    up_to = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("*", *(x for n, v in values.items() for x in (F.coalesce(F.sum(v).over(up_to), F.lit(0)).alias(f"_{n}_in"), F.lag(v).over(inside).alias(f"_{n}_one")))).join(starts, "_block")
    return out.select(*df.columns, *(x for n in values for x in ((F.col(f"_{n}_in") + F.col(f"_{n}_from")).alias(n), F.coalesce(f"_{n}_one", f"_{n}_lag", F.lit(0)).alias(f"{n}_last"))))


def _batch(**columns: np.ndarray) -> pa.Table:
    return pa.table({k: pa.array(np.asarray(v, dtype=np.int64)) for k, v in columns.items()})


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _breaks(own: pa.Table, first: int, most_bytes: int, most_rows: int) -> np.ndarray:
    """Where the next shard begins, for each unit of a range: the first unit before which enough bytes or rows have come
    together. Units are numbered one after the other, so one behind all that is known is the next number."""
    b, n = _column(own, "b"), _column(own, "n")
    at = np.minimum(np.searchsorted(b, b + most_bytes, "left"), np.searchsorted(n, n + most_rows, "left"))
    return first + np.maximum(at, np.arange(len(b)) + 1)


def _followed(i: np.ndarray, target: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(target, steps) of ordered places once pointers to one of them are followed until they point behind all."""
    at, to, far = np.searchsorted(i, target).tolist(), target.tolist(), steps.tolist()
    for k in range(len(to) - 1, -1, -1):
        if (inner := at[k]) < len(to):
            far[k] += far[inner]
            to[k] = to[inner]
    return np.array(to, dtype=np.int64), np.array(far, dtype=np.int64)


def packed(df: DataFrame, index: str, size: str, most_bytes: int, most_rows: int | None = None, rows: str | None = None, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """(index, shard, place): the shard of each row and its place in it, rows in order of ``index`` (their numbers 0, 1,
    ...); a shard is closed once it has ``most_bytes`` bytes of ``size`` or ``most_rows`` rows. rows: a column of how many
    rows a row stands for, 1 if not named. Null and negative sizes count as 0; an empty table gives an empty one. The
    result is that of one sequential pass for any partitioning.

    ``df`` is read a few times; save it, if it is costly. A shard's rows come together in a task as two numbers each."""
    limit = most_rows or 1 << 62
    if most_bytes < 1 or limit < 1:
        raise ValueError("a shard must have room for something")
    at_least_0 = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0))
    own = df.select(F.col(index).cast("long").alias("i"), at_least_0(size).alias("s"), (at_least_0(rows) if rows else F.lit(1)).cast("long").alias("r"))

    def measure(b: Column, n: Column) -> Column:
        """Grows by one or two from a shard's first row to its last, whose own size comes on top."""
        return (F.floor(b / most_bytes) + (F.floor(n / limit) if most_rows else F.lit(0))).cast("long")

    sums = running_sums(own, "i", b=F.col("s"), n=F.col("r"))
    sums = sums.select("i", "b", "n", measure(F.col("b"), F.col("n")).alias("w"), measure(F.col("b") - F.col("b_last"), F.col("n") - F.col("n_last")).alias("p"))
    run = lambda level: F.floor(F.col("w") / (span * fan**level)).cast("long")

    # a range also knows the rows in which a shard that it began can end
    mine = sums.withColumn("g", run(0)).withColumn("mine", F.lit(1).cast("long"))
    ahead = mine.where((F.col("w") - F.col("g") * span <= AHEAD) & (F.col("g") > 0)).withColumn("g", F.col("g") - 1).withColumn("mine", F.lit(0).cast("long"))
    ranges = mine.unionByName(ahead)
    top = sums.agg(F.max("w")).first()[0]
    height = 0
    while top is not None and top >= span * fan**height:
        height += 1

    def in_range(t: pa.Table) -> tuple[pa.Table, int, int]:
        """A range's rows and those after it in order, the first one's number, and how many are its own."""
        t = t.sort_by("i")
        return t, t.column("i")[0].as_py(), int(_column(t, "mine").sum())

    def entered(i: np.ndarray, w: np.ndarray, p: np.ndarray, unit: int) -> np.ndarray:
        """Where the chain can enter from before: the row before was still within the reach of a shard begun there."""
        return (p < w[0] // unit * unit + AHEAD) | (np.arange(len(i)) == 0)

    def climb(t: pa.Table) -> pa.Table:
        t, first, n = in_range(t)
        if not n:
            return _batch(i=[], w=[], p=[], target=[], steps=[])
        i, w, p = (_column(t, c)[:n] for c in "iwp")
        target, steps = _followed(i, _breaks(t, first, most_bytes, limit)[:n], np.ones(n, dtype=np.int64))
        some = entered(i, w, p, span)
        return _batch(i=i[some], w=w[some], p=p[some], target=target[some], steps=steps[some])

    def fold(level: int):
        def folded(t: pa.Table) -> pa.Table:
            t = t.sort_by("i")
            i, w, p = (_column(t, c) for c in "iwp")
            target, steps = _followed(i, _column(t, "target"), _column(t, "steps"))
            some = entered(i, w, p, span * fan**level)
            return _batch(i=i[some], w=w[some], p=p[some], target=target[some], steps=steps[some])

        return folded

    def descend(unit: int):
        def entries(left: pa.Table, right: pa.Table) -> pa.Table:
            """The chain's entries into the ranges of a run, from its entry into the run."""
            out = []
            if left.num_rows and right.num_rows:
                right = right.sort_by("i")
                i, w, target, steps = (_column(right, c) for c in ("i", "w", "target", "steps"))
                at, shard = left.column("i")[0].as_py(), left.column("shard")[0].as_py()
                while (k := int(np.searchsorted(i, at))) < len(i):
                    out.append((w[k] // unit, at, shard))
                    at, shard = target[k], shard + steps[k]
            g, where, number = np.array(out, dtype=np.int64).reshape(-1, 3).T
            return _batch(g=g, i=where, shard=number)

        return entries

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        """The rows of the shards that begin in a range."""
        if not left.num_rows or not right.num_rows:
            return _batch(i=[], shard=[], start=[])
        t, first, n = in_range(right)
        following, at, begins = _breaks(t, first, most_bytes, limit), left.column("i")[0].as_py(), []
        while at < first + n:
            begins.append(at)
            at = int(following[at - first])
        rows_ = np.arange(begins[0], at)  # the last one may reach into the next range
        of = np.searchsorted(begins, rows_, "right") - 1
        return _batch(i=rows_, shard=left.column("shard")[0].as_py() + of, start=np.array(begins)[of])

    pointers = "i long, w long, p long, target long, steps long"
    levels = [ranges.groupBy("g").applyInArrow(climb, pointers)]
    for level in range(1, height):
        levels.append(levels[-1].withColumn("g", run(level)).groupBy("g").applyInArrow(fold(level), pointers))
    entry = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("g"), F.col("id").alias("i"), F.lit(0).cast("long").alias("shard"))
    for level in range(height, 0, -1):
        below = levels[level - 1].withColumn("g", run(level))
        entry = entry.groupBy("g").cogroup(below.groupBy("g")).applyInArrow(descend(span * fan ** (level - 1)), "g long, i long, shard long")
    out = entry.groupBy("g").cogroup(ranges.groupBy("g")).applyInArrow(settle, "i long, shard long, start long")
    return out.select(F.col("i").alias(index), "shard", (F.col("i") - F.col("start")).alias("place"))


def packed_groups(df: DataFrame, group: str, order: str, size: str, most_bytes: int, most_rows: int | None = None, **how: int) -> DataFrame:
    """(group, shard, place): which shard each group of rows goes to; a group is never split.

    Groups come in order of the number ``order`` (a group's least), ties by the group, and a shard is closed once it has
    ``most_bytes`` or ``most_rows``, as in one sequential pass."""
    groups = df.groupBy(group).agg(F.min(order).alias("_o"), F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    placed = with_index(groups, "_o", group, name="_at")
    return placed.select(group, "_at").join(packed(placed, "_at", "_bytes", most_bytes, most_rows, "_rows", **how), "_at").drop("_at")
