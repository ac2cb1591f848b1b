"""Evaluation: precision and recall, baselines, advantages, bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators.ordering import with_index
from lakeloom.operators.scoring import shared_grams


def per_label(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 for each label that is some row's truth."""
    t, p = F.col(truth), F.col(predicted)
    pairs = df.groupBy(t.alias("t"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    true = pairs.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    said = pairs.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    df = true.join(said, "label", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    df = df.withColumn("precision", F.when(F.col("said") > 0, F.col("hits") / F.col("said")).otherwise(0.0)).withColumn("recall", F.col("hits") / F.col("support"))
    both = F.col("precision") + F.col("recall")
    return df.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).drop("hits", "said")


def averaged(labels: DataFrame) -> DataFrame:
    """One row: macro and weighted means of per_label()."""
    names = ("precision", "recall", "f1")
    macro = [F.round(F.avg(c), 6).alias(f"macro_{c}") for c in names]
    return labels.agg(*macro, *(F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 6).alias(f"weighted_{c}") for c in names))


def most_frequent(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """by, value, n, share: each group's most frequent value, of equals the one seen first in ``order``."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    every = Window.partitionBy(by)
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(every)).withColumn("_r", F.row_number().over(every.orderBy(F.desc("n"), "first")))
    return counts.where("_r = 1").drop("_r", "first")


def advantage(df: DataFrame, by: str, reward: str, name: str = "advantage") -> DataFrame:
    """Adds (reward - mean) / (population deviation + 1e-8) within the group: a row a group is joined back."""
    per = df.groupBy(F.col(by).alias("_by")).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_std"))
    out = df.join(per, F.col(by).eqNullSafe(F.col("_by")))
    return out.withColumn(name, (F.col(reward) - F.col("_mean")) / (F.col("_std") + F.lit(1e-8))).drop("_by", "_mean", "_std")


#: Clusters of a leaf of the tree that draws are dealt down.
LEAF = 4096


def leaf_draws(seed: int, draw: int, clusters: int, leaf: int, size: int = LEAF) -> np.ndarray:
    """How often resample number ``draw`` of n of n clusters has each cluster of leaf number ``leaf`` (its first is
    cluster leaf * size).

    The n draws of a resample are dealt down a binary tree over the leaves: at each node a binomial count, seeded by
    (seed, draw, node), goes left. A leaf's count thus follows from the seed alone, and leaves' counts add up to n."""
    count, first, last, node = clusters, 0, -(-clusters // size), 1
    width = lambda lo, hi: min(hi * size, clusters) - lo * size
    while last - first > 1:
        middle = (first + last) // 2
        left = int(np.random.default_rng([seed, draw, node]).binomial(count, width(first, middle) / width(first, last)))
        if leaf < middle:
            count, last, node = left, middle, 2 * node
        else:
            count, first, node = count - left, middle, 2 * node + 1
    own = width(leaf, leaf + 1)
    return np.random.default_rng([seed, draw, node]).multinomial(count, np.full(own, 1 / own))


def bound(means: list[float], alpha: float) -> float:
    """The one-sided lower bound: the ceil(alpha * draws)-th smallest, at least the first."""
    return sorted(means)[max(0, math.ceil(alpha * len(means)) - 1)]


def paired_bootstrap(df: DataFrame, cluster: str, first: str, second: Column | str, draws: int = 2000, alpha: float = 0.05, seed: int = 0, leaf: int = LEAF) -> DataFrame:
    """difference, low, clusters, cases, draws: the mean of first - second over all rows, and its one-sided lower bound, the
    ceil(alpha * draws)-th smallest mean of ``draws`` resamples of n of n whole clusters, the same for both arms.

    Clusters in order of their name are cut into leaves; a task deals the draws of its leaves by itself and sends two
    numbers a draw, which add up. Fewer than two clusters, 100 draws or a score that is null or not finite are errors."""
    if draws < 100 or not 0 < alpha < 0.5:
        raise ValueError("at least 100 draws and an alpha between 0 and 0.5")
    second = F.col(second) if isinstance(second, str) else second
    gap = F.col(first).cast("double") - second.cast("double")
    sound = F.coalesce((F.abs(F.col(first).cast("double")) < F.lit(math.inf)) & (F.abs(second.cast("double")) < F.lit(math.inf)) & ~F.isnan(gap), F.lit(False))
    per = df.groupBy(F.col(cluster).cast("string").alias("cluster")).agg(F.sum(gap).alias("total"), F.count(F.lit(1)).alias("n"), F.max((~sound).cast("int")).alias("bad"))
    placed = with_index(per, "cluster", name="at")
    whole = placed.agg(F.count(F.lit(1)).alias("clusters"), F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("bad").alias("bad")).first()
    if whole.bad or whole.clusters < 2:
        raise ValueError("scores must be finite" if whole.bad else "at least two clusters are needed")
    clusters = whole.clusters

    def resampled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        number, own = int(pdf["at"].iloc[0]) // leaf, pdf[["total", "n"]].to_numpy(dtype=np.float64)
        sums = np.stack([leaf_draws(seed, d, clusters, number, leaf) @ own for d in range(draws)])
        return pd.DataFrame({"leaf": number, "draw": range(draws), "total": sums[:, 0], "n": sums[:, 1]})

    sums = placed.groupBy(F.floor(F.col("at") / leaf).alias("_leaf")).applyInPandas(resampled, "leaf long, draw int, total double, n double")
    means = sums.groupBy("draw").agg((F.sum("total") / F.sum("n")).alias("mean"))
    every = F.array_sort(F.collect_list("mean"))  # ``draws`` numbers
    low = means.agg(F.element_at(every, max(1, math.ceil(alpha * draws))).alias("low"))
    return low.select(F.lit(whole.total / whole.n).alias("difference"), "low", F.lit(clusters).cast("long").alias("clusters"), F.lit(whole.n).cast("long").alias("cases"), F.lit(draws).alias("draws"))


def clustered_bootstrap(df: DataFrame, cluster: str, value: str, draws: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """mean, low, clusters: the mean of a value and its one-sided lower bound, as in paired_bootstrap()."""
    return paired_bootstrap(df, cluster, value, F.lit(0.0), draws, alpha, seed).select(F.col("difference").alias("mean"), "low", "clusters")


def token_f1(df: DataFrame, keys: list[str], prediction: Column, truth: Column) -> DataFrame:
    """keys, f1: F1 of the bags of normalised words; 1 where both are empty, 0 where one is. Nothing is shuffled."""
    rows = df.select(*keys, T.words(T.squad_normal(prediction)).alias("x"), T.words(T.squad_normal(truth)).alias("y"))
    rows = rows.select(*keys, F.size("x").alias("x"), F.size("y").alias("y"), shared_grams(F.col("x"), F.col("y"))[0].alias("same"))
    x, y, same = F.col("x"), F.col("y"), F.col("same")
    return rows.select(*keys, F.when((x == 0) | (y == 0), (x == y).cast("double")).when(same == 0, 0.0).otherwise(2.0 * same / (x + y)).alias("f1"))


def bleu(df: DataFrame, keys: list[str], prediction: Column, truth: Column, order: int = 4) -> DataFrame:
    """keys, bleu: sentence BLEU up to ``order`` words. A count of zero is taken as 0.1, short predictions are
    penalised; 0 where the texts share no word. Nothing is shuffled."""
    p, t = T.words(F.lower(prediction)), T.words(F.lower(truth))
    rows = df.select(*keys, F.size(p).alias("np"), F.size(t).alias("nt"), shared_grams(p, t, order).alias("same"))
    log = lambda n: F.log(F.when(F.col("same")[n] == 0, 0.1).otherwise(F.col("same")[n].cast("double")) / F.greatest(F.col("np") - n, F.lit(1)))
    logs = sum((log(n) for n in range(order)), F.lit(0.0))
    brevity = F.when(F.col("np") > F.col("nt"), 0.0).otherwise(1 - F.col("nt") / F.col("np"))
    return rows.select(*keys, F.when(F.col("same")[0] == 0, 0.0).otherwise(F.exp(logs / order + brevity)).alias("bleu"))
