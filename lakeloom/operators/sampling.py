"""Draws from weighted mixtures, interleaving, prefixes and lookups in a running order. All follow from hashes of a seed,
so reruns and lost executors give the same rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators import ordering
from lakeloom.sources.scratch import Scratch

#: Ranges of groups, a few hundred bytes each, that are sent to all tasks; more meet their rows in a shuffle.
BROADCAST = 10_000


def draws(spark: SparkSession, sizes: list[tuple[str, float, int]], n: int, seed: int) -> DataFrame:
    """(draw, dataset, place): n draws with replacement from datasets (name, weight, rows).

    A dataset comes by its share of the weights, a row of it evenly. The catalogue is a short list, so it stands in the
    plan as an array and a draw looks its dataset up without a join."""
    total = sum(w for _, w, _ in sizes)
    cum = [x / total for x in accumulate(w for _, w, _ in sizes)]
    u, v = ordering.sha_share(F.col("id"), seed), ordering.sha_share(F.col("id"), seed + 1)
    pick = F.least(F.size(F.filter(F.array(*map(F.lit, cum)), lambda c: c <= u)), F.lit(len(sizes) - 1)).cast("int")
    out = spark.range(n).select(F.col("id").alias("draw"), pick.alias("k"), v.alias("v"))
    name, rows = F.array(*(F.lit(s[0]) for s in sizes)), F.array(*(F.lit(s[2]) for s in sizes))
    return out.select("draw", name[F.col("k")].alias("dataset"), F.floor(F.col("v") * rows[F.col("k")]).cast("long").alias("place"))


def grouped_draws(spark: SparkSession, groups: dict[str, list[tuple[str, float, int]]], batches: int, batch: int, seed: int) -> DataFrame:
    """(draw, batch, group, dataset, place): batches of one group each, groups evenly, their datasets by weight."""
    names = sorted(groups)
    flat = [(g, *d) for g in names for d in groups[g]]
    u = ordering.sha_share(F.col("batch"), seed + 2)
    out = spark.range(batches * batch).select(F.col("id").alias("draw"), F.floor(F.col("id") / batch).cast("long").alias("batch"))
    out = out.withColumn("k", F.floor(u * len(names)).cast("int")).withColumn("group", F.array(*map(F.lit, names))[F.col("k")])
    u, v = ordering.sha_share(F.col("draw"), seed), ordering.sha_share(F.col("draw"), seed + 1)
    edges = []
    for g in names:
        total = sum(w for _, w, _ in groups[g])
        edges.append([x / total for x in accumulate(w for _, w, _ in groups[g])])
    first = [0, *accumulate(len(groups[g]) for g in names)][:-1]
    cum = F.array(*(F.array(*map(F.lit, own)) for own in edges))[F.col("k")]
    inside = F.least(F.size(F.filter(cum, lambda c: c <= u)), F.size(cum) - 1)
    at = F.array(*map(F.lit, first))[F.col("k")] + inside
    name, rows = F.array(*(F.lit(d[1]) for d in flat)), F.array(*(F.lit(d[3]) for d in flat))
    return out.withColumn("at", at).select("draw", "batch", "group", name[F.col("at")].alias("dataset"), F.floor(v * rows[F.col("at")]).cast("long").alias("place"))


def interleaved(df: DataFrame, source: str, weights: dict[str, float], *order: str, seed: int, until_first_ends: bool = False) -> DataFrame:
    """Adds idx: an order in which sources mix by weight and none repeats a row.

    A row's key is an exponential variate over its source's weight, so at each place the next source is drawn by the
    weights of those left over. With ``until_first_ends`` rows after the last row of the source that ends first go.
    Sources without a weight weigh 1."""
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col(source) == name, w).otherwise(weight)
    key = -F.log(1 - ordering.sha_share(F.concat_ws(":", *(F.col(c).cast("string") for c in order)), seed)) / weight
    out = ordering.with_index(df.withColumn("_key", key), "_key", *order).drop("_key")
    if until_first_ends:
        end = out.groupBy(source).agg(F.max("idx").alias("end")).agg(F.min("end").alias("end"))
        out = out.join(F.broadcast(end)).where("idx <= end").drop("end")  # one row
    return out


def _parted(df: DataFrame, group: str, order: tuple[str, ...], ranges: int, most: int) -> DataFrame:
    """``df`` with _part: numbers of ranges that follow the order within each group.

    The first column's quantiles over all rows cut every group alike. A group's range that is still larger than ``most``
    rows is cut by its own quantiles: by the same column, or by the next one where the column has one value in it, and so
    on, so that a hot group and ties are spread as far as the columns tell rows apart."""
    values = ordering._numbers(order, dict(df.dtypes))
    quantiles = [k / ranges for k in range(1, ranges)]
    wide = 2 * ranges + 2

    def cut(value, cuts):
        """0 for nulls; else odd between two cuts, and even on one: only there and at 0 the range has but one value."""
        return F.when(value.isNull(), 0).otherwise(1 + 2 * F.size(F.filter(cuts, lambda c: c < value)) + F.array_contains(cuts, value).cast("int"))

    scratch: list[Scratch] = []
    first = df.select(F.percentile_approx(values[0], quantiles, 10_000)).first()[0] or []
    out = df.withColumn("_part", cut(values[0], F.array(*map(F.lit, sorted(set(first)))).cast("array<double>")).cast("long"))
    for value, of_one in [(values[0], False), *((v, True) for v in values[1:])]:
        if not scratch and (out.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0) <= most:
            return out  # as a rule: one look at the numbers
        cells = out.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        large = cells.where((F.col("_n") > most) & (F.pmod("_p", F.lit(2)) == (0 if of_one else 1))).select("_g", "_p")
        n = large.count()
        if not n:
            continue
        if not scratch:
            scratch.append(Scratch(df.sparkSession))
        out = scratch[0].saved(out)  # what follows reads it three times, and each stage builds on the one before
        large = scratch[0].saved(large)
        same = out[group].eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))
        own = out.join(F.broadcast(large) if n <= BROADCAST else large, same).groupBy("_g", "_p").agg(F.array_distinct(F.percentile_approx(value, quantiles, 10_000)).alias("_cuts"))
        own = own.withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<double>")))
        # each stage shifts the numbers of before, so that an untouched range keeps its parity at the end
        part = F.when(F.col("_cuts").isNotNull(), F.col("_part") * wide + cut(value, F.col("_cuts"))).otherwise(F.col("_part") * wide + F.pmod(F.col("_part"), F.lit(2)))
        out = out.join(F.broadcast(own) if n <= BROADCAST else own, same, "left").withColumn("_part", part.cast("long")).drop("_g", "_p", "_cuts")
    return out


def ranked_in_group(df: DataFrame, group: str, *order: str, ranges: int = ordering.RANGES, most: int = ordering.RANGE_ROWS) -> DataFrame:
    """Adds rank (from 0) and n: a row's place in its group and the group's rows.

    A range of a group is ordered by itself, so that a hot group and rows that tie are spread over tasks; a row a group and
    range says where the range begins."""
    placed = _parted(df, group, order, ranges, most)
    counts = placed.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy("_g")
    before = F.sum("_n").over(every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_g", "_p", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("n"))
    own = Window.partitionBy(group, "_part").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    out = placed.withColumn("_k", F.row_number().over(own) - 1).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("rank", F.col("_k") + F.col("_before")).drop("_part", "_g", "_p", "_k", "_before")


def running_in_group(df: DataFrame, group: str, value: str, *order: str, ranges: int = ordering.RANGES, most: int = ordering.RANGE_ROWS) -> DataFrame:
    """Adds steps and total: how many rows of a row's group come up to it, and their values' sum. Cut into ranges as in
    ranked_in_group()."""
    placed = _parted(df, group, order, ranges, most)
    per = placed.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_g", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_nb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_sb"))
    own = Window.partitionBy(group, "_part").orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("_k", F.row_number().over(own)).withColumn("_t", F.coalesce(F.sum(value).over(own), F.lit(0)))
    out = out.join(per, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("steps", (F.col("_k") + F.col("_nb")).cast("long")).withColumn("total", F.col("_t") + F.col("_sb")).drop("_part", "_g", "_p", "_k", "_t", "_nb", "_sb")


def prefix_share(df: DataFrame, group: str, share: float, *order: str) -> DataFrame:
    """The first max(1, floor(n * share)) rows of each group."""
    out = ranked_in_group(df, group, *order)
    return out.where(F.col("rank") < F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)))).drop("rank", "n")


def steps_of(lengths: DataFrame, key: str, length: str) -> DataFrame:
    """(idx, key, step): every step of every episode under a running index, episodes in order of their key."""
    ordered = ordering.with_index(lengths.where(F.col(length) > 0).select(key, F.explode(F.sequence(F.lit(0), F.col(length) - 1)).alias("step")), key, "step")
    return ordered.select("idx", key, F.col("step").cast("long").alias("step"))
