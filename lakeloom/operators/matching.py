"""Joins with rules about what happens to rows that match not at all, more than once, or elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def by_path(rows: DataFrame, path: str, files: DataFrame, file: str, value: str) -> DataFrame:
    """rows with ``value`` of the file of the same path, else of the first file (by path) of the same base name.

    Adds how: path, name or none. Two equi-joins; rows with a null path match nothing."""
    exact = files.groupBy(F.col(file).alias(path)).agg(F.min(value).alias("_exact"), F.lit(True).alias("_there"))
    named = files.groupBy(base_name(F.col(file)).alias("_name")).agg(F.min(F.struct(file, value)).alias("_first"))
    first = rows.join(exact, path, "left")
    # rows that are matched or have no path stay out of the second join: they would all be dealt to its null key
    done = first.where(F.col("_there").isNotNull() | F.col(path).isNull()).select(*rows.columns, F.col("_exact").alias(value), F.when(F.col("_there"), "path").otherwise("none").alias("how"))
    rest = first.where(F.col("_there").isNull() & F.col(path).isNotNull()).withColumn("_name", base_name(F.col(path))).join(named, "_name", "left")
    return done.unionByName(rest.select(*rows.columns, F.col(f"_first.{value}").alias(value), F.when(F.col("_first").isNotNull(), "name").otherwise("none").alias("how")))


def resolved(rows: DataFrame, found: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """rows with the least ``value`` found for their key, the number found, and a status: unresolved (none),
    ambiguous (more than ``most``) or resolved. Ambiguous rows get no value."""
    per_key = found.groupBy(key).agg(F.count(F.lit(1)).alias("found"), F.min(value).alias(value))
    out = rows.join(per_key, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    status = F.when(F.col("found") == 0, "unresolved").when(F.col("found") > most, "ambiguous").otherwise("resolved")
    return out.withColumn("status", status).withColumn(value, F.when(F.col("status") == "resolved", F.col(value)))


def with_latest(rows: DataFrame, events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """rows with the values of their key's last event; a row without events keeps nulls."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    return rows.join(last, key, "left").select(*rows.columns, *(F.col(f"_last.{v}").alias(v) for v in values))


def agreed(targets: DataFrame, key: str, value: str, *others: DataFrame) -> DataFrame:
    """(key, value, values): keys that every other frame has too, with the number of different values; equal
    duplicates collapse, and a key with more than one value is a conflict and gets none."""
    out = targets.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(value).alias("values"), F.min(value).alias(value))
    for other in others:
        out = out.join(other.select(key), key, "left_semi")
    return out.select(key, F.when(F.col("values") <= 1, F.col(value)).alias(value), "values")


def complete_grid(cases: DataFrame, axes: dict[str, list], scores: DataFrame, value: str) -> DataFrame:
    """Every case under every combination of ``axes`` (short lists), with its score; a missing row is a failure and
    counts 0."""
    grid = cases
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    keys = grid.columns
    got = scores.groupBy(*keys).agg(F.avg(value).alias(value))
    return grid.join(got, keys, "left").withColumn("failed", F.col(value).isNull()).withColumn(value, F.coalesce(value, F.lit(0.0)))
