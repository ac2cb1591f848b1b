"""Audits: leakage across splits, duplicates, missing keys, column profiles, composition of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leakage(df: DataFrame, split: str, **keys: Column) -> DataFrame:
    """kind, key, splits, rows: keys of a kind that rows of more than one split have. Null keys don't count."""
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key")) for kind, key in keys.items()))
    rows = df.select(F.col(split).alias("split"), F.explode(each).alias("k")).select("split", "k.*").where("key is not null")
    counts = rows.groupBy("kind", "key", "split").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n_splits"), F.array_join(F.array_sort(F.collect_list("split")), ",").alias("splits"), F.sum("n").alias("rows"))
    return found.where("n_splits > 1").drop("n_splits")


def first_of_equals(df: DataFrame, key: Column, order: str) -> DataFrame:
    """order value, the first order value of the row's key, and whether the row is that first one."""
    rows = df.select(F.col(order), key.alias("key"))
    first = rows.groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    return rows.join(first, "key").select(order, "first", "copies", (F.col(order) == F.col("first")).alias("kept"))


def merged(df: DataFrame, key: list[str], source: str, status: str, order: str) -> DataFrame:
    """One row a key: its sources as a sorted list, the worst status (ambiguous before resolved), and its place."""
    worst = F.when(F.max((F.col(status) == "ambiguous").cast("int")) == 1, "ambiguous").otherwise("resolved")
    return df.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"), worst.alias("status"), F.min(order).alias("first"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, nulls, blanks, distinct, duplicates: a row for each column, in one scan and one shuffle."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))
    counts = df.select(F.explode(each).alias("c")).groupBy("c.column", "c.v").agg(F.count(F.lit(1)).alias("n"))
    none, blank = F.col("v").isNull(), F.trim("v") == ""
    total = lambda w: F.coalesce(F.sum(F.when(w, F.col("n"))), F.lit(0)).cast("long")
    return counts.groupBy("column").agg(F.sum("n").alias("rows"), total(none).alias("nulls"), total(blank).alias("blanks"), F.count("v").alias("distinct"), (total(~none) - F.count("v")).alias("duplicates"))


def composition(df: DataFrame, index: str, window: int, source: str, top: int | None = None) -> DataFrame:
    """window, source, n, share, rank: what each run of ``window`` rows in stream order is made of."""
    counts = df.groupBy(F.floor(F.col(index) / window).cast("long").alias("window"), source).agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("_first"))
    own = Window.partitionBy("window")
    counts = counts.withColumn("share", F.col("n") / F.sum("n").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("n"), "_first"))).drop("_first")
    return counts if top is None else counts.where(F.col("rank") <= top)


def matched_both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and side of what has no partner: ``left`` rows of a, ``right`` rows of b."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    joined = x.join(y, key, "full_outer")
    return joined.where("_a is null or _b is null").select(key, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def fingerprint(df: DataFrame, columns: list[str], digits: int | None = None, bucket_rows: int = 4096) -> DataFrame:
    """One row: a sha-256 that depends on the rows' values and not on their order, and the number of rows.

    Row digests are hashed in sorted order within buckets of about ``bucket_rows`` rows, by their first digits, and the
    buckets' digests in the same way, until one is left: ``digits``, or so many that no bucket is large.
    Equal rows are one digest with their number. A null is told from an empty text."""
    fields = F.concat_ws("\u001f", *(F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in columns))
    level = df.select(F.sha2(fields.cast("binary"), 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rows, distinct = level.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if digits is None:
        digits = next(k for k in range(64) if distinct <= bucket_rows * 16**k)
    level = level.select(F.substring("h", 1, digits).alias("b"), F.concat_ws(":", "h", F.col("n").cast("string")).alias("h"))
    joined = lambda c: F.sha2(F.array_join(c, ",").cast("binary"), 256)
    while True:
        level = level.groupBy("b").agg(joined(F.array_sort(F.collect_list(F.concat_ws("=", "b", "h")))).alias("h"))
        if digits == 0:
            break
        digits = max(0, digits - 3)
        level = level.select(F.substring("b", 1, digits).alias("b"), "h")
    return level.groupBy().agg(joined(F.collect_list("h")).alias("fingerprint"), F.lit(rows).cast("long").alias("rows"))  # one digest
