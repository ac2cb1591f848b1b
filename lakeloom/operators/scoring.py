"""Scores of predictions, rewards, traces and runs. Each is one aggregation; what is compared in a row stays in the row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lakeloom.functions import text as T
from lakeloom.operators import ordering, sampling


def _share(condition: Column) -> Column:
    """The share of rows that meet a condition; null counts as no, and no rows give 0."""
    return F.coalesce(F.avg(F.coalesce(condition.cast("double"), F.lit(0.0))), F.lit(0.0))


def bag_overlaps(x: pa.ListArray | pd.Series, y: pa.ListArray | pd.Series, order: int) -> np.ndarray:
    """A row for each pair of word lists: how many n-grams their bags share, for n = 1..order. All rows at once: words and
    then n-grams are numbered, and equal numbers of a row are counted on either side."""
    x, y = (v if isinstance(v, pa.Array) else pa.array(list(v), pa.list_(pa.string())) for v in (x, y))
    n = len(x)
    sizes = np.concatenate([pc.list_value_length(v).to_numpy(zero_copy_only=False) for v in (x, y)]).astype(np.int64)
    words = pa.concat_arrays([x.flatten(), y.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(2 * n), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # words from here to the end of the list
    out, gram = np.zeros((n, order), dtype=np.int64), words
    for k in range(1, order + 1):
        if k > 1:
            whole = np.flatnonzero(left >= k)
            gram = np.full(len(words), -1)
            gram[whole] = np.unique(before[whole] * (words.max(initial=0) + 1) + words[whole + k - 1], return_inverse=True)[1]
        at = np.flatnonzero(left >= k)
        key = (row[at] % max(n, 1)) * (gram.max(initial=0) + 1) + gram[at]
        (a, m), (b, o) = (np.unique(key[own], return_counts=True) for own in (row[at] < n, row[at] >= n))
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        out[:, k - 1] = np.bincount(both // (gram.max(initial=0) + 1), np.minimum(m[i], o[j]), n)
        before = gram
    return out


#: Words that n-grams are counted of at once; a pair of longer texts is counted by itself.
WORDS = 200_000


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (from, to) of at most ``most`` words together, one row at least."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, end
        start = end


@F.arrow_udf(ArrayType(LongType()))  # a type by name would need a session
def _shared_grams(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Words stay in Arrow's buffers but for those of a run of rows, as a batch may have many."""
    for x, y, order in batches:
        sizes, out = sum(pc.list_value_length(v).to_numpy(zero_copy_only=False) for v in (x, y)), []
        for start, end in _runs(sizes, WORDS):
            own = [v.slice(start, end - start) for v in (x, y)]
            out.append(bag_overlaps(*own, order[0].as_py()))
        flat = np.concatenate(out) if out else np.zeros((0, 1), dtype=np.int64)
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def shared_grams(x: Column, y: Column, order: int = 1) -> Column:
    """Sizes of the bag intersections of two word lists' n-grams, n = 1..order; nulls are empty lists."""
    none = F.array().cast("array<string>")
    return _shared_grams(F.coalesce(x, none), F.coalesce(y, none), F.lit(order))


def summary(df: DataFrame, truth: str, predicted: str, formatted: Column, forced: Column) -> DataFrame:
    """One row: n, accuracy, format_rate, forced_rate, majority_baseline (the share of the most frequent truth)."""
    right = F.col(truth).eqNullSafe(F.col(predicted))
    per = df.groupBy(truth).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce(c.cast("long"), F.lit(0))).alias(k) for k, c in (("right", right), ("formatted", formatted), ("forced", forced))))
    n = F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *((F.coalesce(F.sum(c), F.lit(0)) / n).alias(k) for k, c in (("accuracy", "right"), ("format_rate", "formatted"), ("forced_rate", "forced"))), (F.coalesce(F.max("n"), F.lit(0)) / n).alias("majority_baseline"))


def per_truth(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, n, correct: a row for each label."""
    return df.groupBy(truth).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(truth).eqNullSafe(F.col(predicted))).cast("long")).alias("correct"))


def mean_scores(df: DataFrame, *scores: str) -> DataFrame:
    """One row: n and the mean of each score."""
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.avg(s).alias(s) for s in scores))


def judged(df: DataFrame, score: str, *by: str) -> DataFrame:
    """By group: n, and count and share of the scores 1 (correct), 0.5 (partial) and 0 (incorrect)."""
    names = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0}
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce((F.col(score) == v).cast("long"), F.lit(0))).alias(k) for k, v in names.items()), *(_share(F.col(score) == v).alias(f"{k}_share") for k, v in names.items()))


def mean_absolute_error(df: DataFrame, predicted: str, truth: str, *by: str) -> DataFrame:
    """By group: n, mae over the rows where both are numbers."""
    off = F.abs(F.col(predicted) - F.col(truth))
    off = F.when(~F.isnan(off), off)
    return df.groupBy(*by).agg(F.count(off).alias("n"), F.avg(off).alias("mae"))


def horizon_error(df: DataFrame, series: str, predicted: str, truth: str) -> DataFrame:
    """series, steps, mae for each row: the mean absolute error over as many steps as both arrays have; none: null."""
    steps = F.least(F.size(predicted), F.size(truth))
    off = F.zip_with(F.slice(predicted, 1, F.greatest(steps, F.lit(0))), F.slice(truth, 1, F.greatest(steps, F.lit(0))), lambda p, g: F.abs(p - g))
    return df.select(series, steps.alias("steps"), F.when(steps > 0, F.aggregate(off, F.lit(0.0), lambda a, x: a + x) / steps).alias("mae"))


def corpus_bleu(df: DataFrame, prediction: Column, truth: Column, order: int = 4) -> DataFrame:
    """One row: n, bleu. N-gram counts of all rows are summed before they are divided; 0 where some order has no match.

    Texts are cut at white space. The brevity penalty compares the summed lengths."""
    p, t = T.words(prediction), T.words(truth)
    rows = df.select(F.size(p).alias("np"), F.size(t).alias("nt"), shared_grams(p, t, order).alias("same"))
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("np").alias("np"), F.sum("nt").alias("nt"),
        *(F.sum(F.col("same")[k]).alias(f"s{k}") for k in range(order)), *(F.sum(F.greatest(F.col("np") - k, F.lit(0))).alias(f"m{k}") for k in range(order)),
    )
    log = sum((F.log(F.col(f"s{k}") / F.col(f"m{k}")) for k in range(order)), F.lit(0.0)) / order
    brevity = F.when(F.col("np") > F.col("nt"), 0.0).otherwise(1 - F.col("nt") / F.col("np"))
    whole = [F.col(f"s{k}") > 0 for k in range(order)]
    some = whole[0]
    for c in whole[1:]:
        some = some & c
    return sums.select("n", F.when(some, F.exp(log + brevity)).otherwise(0.0).alias("bleu"))


def answer_rates(df: DataFrame, prediction: Column, truth: Column, *by: str) -> DataFrame:
    """By group: n, and the shares of answers that equal the truth, hold it, and name the same option letter first."""
    p, t = T.plain_answer(prediction), T.plain_answer(truth)
    option = T.option_letter(prediction) == T.option_letter(truth)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _share(p == t).alias("exact"), _share((t != "") & F.contains(p, t)).alias("containment"), _share(option).alias("option"))


def reward_breakdown(df: DataFrame, rewards: list[str], *by: str) -> DataFrame:
    """By group and reward (and ``mean``, each row's mean over all): mean, population deviation, least, most, successes
    (scores above 0)."""
    total = sum((F.col(r) for r in rewards), F.lit(0.0)) / len(rewards)
    each = F.array(*(F.struct(F.lit(r).alias("reward"), F.col(r).cast("double").alias("score")) for r in rewards), F.struct(F.lit("mean").alias("reward"), total.alias("score")))
    rows = df.select(*by, F.explode(each).alias("r")).select(*by, "r.*")
    s = F.col("score")
    return rows.groupBy(*by, "reward").agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), F.sum((s > 0).cast("long")).alias("successes"))


def token_parity(df: DataFrame, left: str, right: str, window: int, least: int) -> DataFrame:
    """Adds matches (equal ids within the first ``window`` of both) and passed (at least ``least`` of them)."""
    width = F.least(F.size(left), F.size(right), F.lit(window))
    same = F.zip_with(F.slice(left, 1, width), F.slice(right, 1, width), lambda a, b: (a == b).cast("int"))
    return df.withColumn("matches", F.coalesce(F.aggregate(same, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0))).withColumn("passed", F.col("matches") >= least)


def trace_report(left: DataFrame, right: DataFrame, boundary: str, values: str, kind: str, absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """boundary, verdict, max_abs: how two traces' arrays agree at each boundary.

    verdict: missing (one side has none), shape (length or kind differ), nonfinite, mismatch, or passed: every
    |a - b| <= absolute + relative * |b|. max_abs only where the shapes agree and all values are finite."""
    a = left.select(boundary, F.col(values).alias("_a"), F.col(kind).alias("_ka"), F.lit(True).alias("_la"))
    b = right.select(boundary, F.col(values).alias("_b"), F.col(kind).alias("_kb"), F.lit(True).alias("_lb"))
    df = a.join(b, boundary, "full_outer")
    finite = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    shape = (F.size("_a") == F.size("_b")) & F.col("_ka").eqNullSafe(F.col("_kb"))
    near = F.forall(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y) <= absolute + relative * F.abs(y)), lambda x: x)
    verdict = F.when(F.col("_la").isNull() | F.col("_lb").isNull(), "missing").when(~F.coalesce(shape, F.lit(False)), "shape").when(~(finite("_a") & finite("_b")), "nonfinite").when(near, "passed").otherwise("mismatch")
    df = df.withColumn("verdict", verdict)
    most = F.coalesce(F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y).cast("double"))), F.lit(0.0))
    return df.select(boundary, "verdict", F.when(F.col("verdict").isin("passed", "mismatch"), most).alias("max_abs"))


def paired_control(df: DataFrame, matched: str, wrong: str, *by: str) -> DataFrame:
    """By group: pairs, the mean losses, the mean of wrong - matched, and how often the matched one is smaller."""
    m, w = F.col(matched), F.col(wrong)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.avg(m).alias("matched_loss"), F.avg(w).alias("wrong_loss"), F.avg(w - m).alias("wrong_minus_matched"), F.sum((m < w).cast("long")).alias("matched_wins"))


def replicas(df: DataFrame, value: str, *by: str) -> DataFrame:
    """By group: n, mean, sample deviation (null for one row), and it over the mean's size."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return out.withColumn("relative", F.try_divide(F.col("std"), F.abs("mean")))


def mean_interval(df: DataFrame, cluster: str, value: str, draws: int = 200, low: float = 0.025, high: float = 0.975, seed: int = 0) -> DataFrame:
    """One row: clusters, mean, low, high: percentiles of the mean over resamples of whole clusters.

    A cluster's count in a draw is Poisson(1), from a hash of seed, draw and cluster; draws without clusters don't count.
    Clusters are summed first, so a draw costs a row a cluster and its sums a row."""
    per = df.groupBy(cluster).agg(F.sum(value).cast("double").alias("total"), F.count(value).alias("n"))
    limits, term, cum = [], math.exp(-1), 0.0
    for k in range(12):
        cum += term
        limits.append(round(cum, 12))
        term /= k + 1
    drawn = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = ordering.md5_share(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col(cluster).cast("string")))
    times = sum(((u >= x).cast("int") for x in limits), F.lit(0))
    means = drawn.groupBy("draw").agg(F.sum(times * F.col("total")).alias("s"), F.sum(times * F.col("n")).alias("c")).where("c > 0").select((F.col("s") / F.col("c")).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))
    return per.agg(F.count(F.lit(1)).alias("clusters"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean")).join(ends)  # one row each


def trusted_vertices(points: DataFrame, fits: DataFrame, by: str, x: str, loss: str, slack: float = 0.5) -> DataFrame:
    """fits (by, vertex, predicted) with trusted: the vertex lies within the points' x and its predicted loss within
    ``slack`` of the loss range beyond the losses seen."""
    seen = points.groupBy(by).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(loss).alias("_y0"), F.max(loss).alias("_y1"))
    room = (F.col("_y1") - F.col("_y0")) * slack
    inside = F.col("vertex").between(F.col("_x0"), F.col("_x1")) & F.col("predicted").between(F.col("_y0") - room, F.col("_y1") + room)
    return fits.join(seen, by, "left").withColumn("trusted", F.coalesce(inside, F.lit(False))).drop("_x0", "_x1", "_y0", "_y1")


def step_shares(df: DataFrame, parts: list[str], *by: str, items: int = 1) -> DataFrame:
    """By group: steps, each part's mean and share of the mean step, and items over the mean step."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("steps"), *(F.avg(p).alias(p) for p in parts))
    whole = sum((F.col(p) for p in parts), F.lit(0.0))
    return out.withColumns({**{f"{p}_share": F.try_divide(F.col(p), whole) for p in parts}, "throughput": F.try_divide(F.lit(float(items)), whole)})


def after_warmup(df: DataFrame, by: str, order: str, value: str, running: str, warmup: int) -> DataFrame:
    """By group: n and mean of the numbers in the string column ``value`` after the first ``warmup`` rows (all rows of
    a group of no more), and the last number of ``running``."""
    number = lambda c: F.expr(f"try_cast({c} as double)")
    ranked = sampling.ranked_in_group(df, by, order)
    own = F.when(((F.col("rank") >= warmup) | (F.col("n") <= warmup)) & ~F.isnan(number(value)), number(value))
    return ranked.groupBy(by).agg(F.count(own).alias("n"), F.avg(own).alias("mean"), F.max_by(number(running), order).alias("last"))
