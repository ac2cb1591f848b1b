"""Catalogues and mixtures: weights, overrides, proportions, coverage, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(df: DataFrame, weight: str, by: list[str] | None = None, name: str = "share") -> DataFrame:
    """Adds each row's share of its group's weight; equal shares where the weights add up to nothing."""
    every = Window.partitionBy(*(by or []))
    total = F.sum(weight).over(every)
    return df.withColumn(name, F.when(total > 0, F.col(weight) / total).otherwise(1.0 / F.count(F.lit(1)).over(every)))


def resolve(datasets: DataFrame, preset: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The active datasets of a preset's groups, with weight and proportion.

    datasets: dataset, group, weight, proportion, skip. preset: group. overrides: dataset, weight, proportion, level
    (higher levels win, nulls override nothing). Missing weights and proportions are 1; skipped datasets and those
    without a positive weight are left out; groups that no dataset has are ignored."""
    df = datasets.join(F.broadcast(preset.select("group").distinct()), "group", "left_semi")
    if overrides is not None:
        top = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("level"))).alias(f"_{c}")
        chosen = overrides.groupBy("dataset").agg(top("weight"), top("proportion"))
        df = df.join(chosen, "dataset", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("weight", "proportion")}).drop("_weight", "_proportion")
    df = df.withColumns({c: F.coalesce(c, F.lit(1.0)) for c in ("weight", "proportion")})
    return df.where(~F.coalesce("skip", F.lit(False)) & (F.col("weight") > 0))


def prefix_count(n: Column, proportion: Column) -> Column:
    """How many of n items a proportion keeps: all from 1 on, at least one below."""
    return F.when((proportion > 0) & (proportion < 1), F.greatest(F.lit(1), F.floor(n * proportion))).otherwise(n).cast("long")


def coverage(datasets: DataFrame, draws: int, size: str = "samples", weight: str = "weight") -> DataFrame:
    """Expected draws of each dataset from ``draws`` in all, the passes over it they make, and the draws that one pass
    over every dataset takes."""
    every = Window.partitionBy()
    df = shares(datasets, weight)
    df = df.withColumn("expected", F.col("share") * draws).withColumn("passes", F.try_divide(F.col("expected"), F.col(size)))
    return df.withColumn("full_pass", F.max(F.try_divide(F.col(size), F.col("share"))).over(every))


def class_weights(df: DataFrame, label: str, cap: float = 10.0) -> DataFrame:
    """label, n and weight = all / (classes * n), at most ``cap``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return counts.withColumn("weight", F.least(F.lit(cap), F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))))
