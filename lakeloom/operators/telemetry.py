"""Run logs: warm-up trimming, last values, stragglers, running totals, upserts, fits of scaling laws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.sampling import ranked_in_group


def after_warmup(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """Without the first n rows of each group that has more than n. The first order column is a number."""
    ranked = ranked_in_group(df.withColumn("_group", F.struct(*by)), "_group", *order)
    return ranked.where((F.col("n") <= n) | (F.col("rank") >= n)).drop("_group", "rank", "n")


def last_k(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The last k rows of each group. The first order column is a number."""
    ranked = ranked_in_group(df.withColumn("_group", F.struct(*by)), "_group", *order)
    return ranked.where(F.col("rank") >= F.col("n") - k).drop("_group", "rank", "n")


def stragglers(df: DataFrame, by: list[str], worker: str, value: str, limit: float = 1.5) -> DataFrame:
    """Least, most and mean value of each group, who has them (of equals the smaller), their ratio, and whether it is
    over the limit."""
    least, most = F.min(F.struct(value, worker)), F.max(F.struct(F.col(value), -F.col(worker)))
    out = df.groupBy(*by).agg(least.alias("lo"), most.alias("hi"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    ratio = F.when(F.col(f"lo.{value}") > 0, F.col(f"hi.{value}") / F.col(f"lo.{value}"))
    return out.select(*by, F.col(f"lo.{value}").alias("least"), F.col(f"lo.{worker}").alias("least_at"), F.col(f"hi.{value}").alias("most"), (-F.col("hi.col2")).alias("most_at"), "mean", "n", ratio.alias("ratio"), F.coalesce(ratio > limit, F.lit(False)).alias("straggles"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """Rows of both by key: new values win where they are not null, but for the columns ``keep``, where old ones do."""
    rest = [c for c in old.columns if c not in key]
    a, b = (df.select(*key, *(F.col(c).alias(f"_{s}_{c}") for c in rest)) for df, s in ((old, "o"), (new, "n")))
    joined = a.join(b, key, "full_outer")
    pick = lambda c: F.coalesce(*(f"_{s}_{c}" for s in ("on" if c in keep else "no"))).alias(c)
    return joined.select(*key, *map(pick, rest))


def power_law(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """exponent and log10 of the factor of y = factor * x ** exponent by least squares on logarithms; n points."""
    lx, ly = F.log10(x), F.log10(y)
    fit = df.where(f"{x} > 0 and {y} > 0").groupBy(*by).agg(F.regr_slope(ly, lx).alias("exponent"), F.regr_intercept(ly, lx).alias("log_factor"), F.count(F.lit(1)).alias("n"))
    return fit


def parabola(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """a, b, c of y = a x^2 + b x + c by least squares, its vertex, and whether it is a trusted minimum: a > 1e-12, the
    vertex inside the data, and its value within half the data's range beyond it. Needs three different x.

    Sums of powers of x about its group's mean make the 3 x 3 normal equations, solved by Cramer's rule."""
    d = df.where(f"{x} is not null and {y} is not null")
    means = d.groupBy(F.struct(*by).alias("_of")).agg(F.avg(x).alias("_m"))  # a row a group
    d = d.join(means, F.struct(*by).eqNullSafe(F.col("_of"))).withColumn("_x", F.col(x) - F.col("_m"))
    s = lambda k: F.sum(F.pow("_x", F.lit(float(k))))
    t = lambda k: F.sum(F.pow("_x", F.lit(float(k))) * F.col(y))
    g = d.groupBy(*by).agg(
        *(s(k).alias(f"s{k}") for k in range(5)), *(t(k).alias(f"t{k}") for k in range(3)), F.max("_m").alias("m"), F.countDistinct(x).alias("points"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.min(y).alias("y_lo"), F.max(y).alias("y_hi")
    ).where("points >= 3")
    det = "(s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2))"
    g = g.withColumn("a", F.expr(f"(t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / {det}"))
    g = g.withColumn("b0", F.expr(f"(s4 * (t1 * s0 - s1 * t0) - t2 * (s3 * s0 - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / {det}"))
    g = g.withColumn("c0", F.expr(f"(s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2)) / {det}"))
    g = g.withColumn("vertex", F.expr("case when a > 1e-12 then m - b0 / (2 * a) end")).withColumn("value", F.expr("case when a > 1e-12 then c0 - b0 * b0 / (4 * a) end"))
    trusted = F.expr("a > 1e-12 and vertex between lo and hi and value between y_lo - 0.5 * (y_hi - y_lo) and y_hi + 0.5 * (y_hi - y_lo)")
    return g.select(*by, "points", "a", F.expr("b0 - 2 * a * m").alias("b"), F.expr("c0 - b0 * m + a * m * m").alias("c"), "vertex", "value", F.coalesce(trusted, F.lit(False)).alias("trusted"))
