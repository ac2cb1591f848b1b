"""Flat-file records and variants: fields with continuation lines, tokens, coordinates, sequences, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_fields(records: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, field, value: the lines of each record, a row of ``records``; an indented line belongs to the field before
    it. Lines are told apart within their row, so nothing is shuffled or sorted."""
    raw = F.filter(F.transform(F.split(text, "\n"), lambda x, k: F.struct(k.alias("line"), x.alias("raw"))), lambda x: F.trim(x["raw"]) != "")
    lines = records.select(key, raw.alias("_raw")).select(key, "_raw", F.transform("_raw", lambda x: F.nullif(F.regexp_extract(x["raw"], r"^(\S+)", 1), F.lit(""))).alias("_named"))
    # the field of a line is the last that begins in the lines up to it
    last = lambda k: F.element_at(F.filter(F.concat(F.array(F.lit(None).cast("string")), F.slice("_named", 1, k + 1)), lambda n, at: (at == 0) | n.isNotNull()), -1)
    value = lambda x, k: F.trim(F.when(F.get("_named", k).isNotNull(), F.regexp_replace(x["raw"], r"^\S+", "")).otherwise(x["raw"]))
    return lines.select(key, F.explode(F.transform("_raw", lambda x, k: F.struct(x["line"].alias("line"), last(k).alias("field"), value(x, k).alias("value")))).alias("_l")).select(key, "_l.*")


#: Records whose tokens a task orders.
RECORDS = 500_000


def variant_tokens(fields: DataFrame, key: str, pattern: str = r"\d+v\d+", records: int | None = None) -> DataFrame:
    """key, token, place: the distinct tokens of each record, in order of first appearance.

    If it is known how many records there are, they are dealt to as many tasks as they ask for, so that the memory of one
    does not grow with the table."""
    tokens = fields.select(key, "line", F.posexplode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("at", "token"))
    dealt = tokens if records is None else tokens.repartition(max(fields.sparkSession.sparkContext.defaultParallelism, -(-records // RECORDS)), key)
    first = dealt.groupBy(key, "token").agg(F.min(F.struct("line", "at")).alias("first"))
    return first.select(key, "token", (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).cast("long").alias("place"))


def coordinates(spdi: Column) -> Column:
    """seq, pos, ref, alt of ``seq:pos:ref:alt``; null unless there are four parts and the position is a number."""
    parts = F.split(spdi, ":", -1)
    pos = F.get(parts, 1).try_cast("long")
    return F.when((F.size(parts) == 4) & pos.isNotNull(), F.struct(F.get(parts, 0).alias("seq"), pos.alias("pos"), F.get(parts, 2).alias("ref"), F.get(parts, 3).alias("alt")))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: a row for each rule that a row of ``df`` breaks (its condition is not true)."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))
