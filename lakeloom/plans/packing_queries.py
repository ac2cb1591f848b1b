"""Queries for shards packed in one order, and for selections that depend on what was selected before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lakeloom.functions import blake2
from lakeloom.operators import crystals, metrics, ordering, packing, pairing, selection
from lakeloom.plans.queries import query, t
from lakeloom.sources.scratch import Scratch


def _one_pass(units: str, most_bytes: int, most_rows: int, out: str) -> str:
    """SQL that walks from shard to shard over units (pos, key, bytes, rows)."""
    return f"""
WITH RECURSIVE u AS MATERIALIZED ({units}),
s AS MATERIALIZED (SELECT *, sum(bytes) OVER (ORDER BY pos) - bytes AS b, sum(rows) OVER (ORDER BY pos) - rows AS n FROM u),
w AS (
  SELECT CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS start, CAST(0 AS HUGEINT) AS b, CAST(0 AS HUGEINT) AS n
  UNION ALL
  SELECT shard + 1, x.pos, x.b, x.n FROM w, LATERAL (SELECT s.pos, s.b, s.n FROM s WHERE s.pos > w.start AND (s.b >= w.b + {most_bytes} OR s.n >= w.n + {most_rows}) ORDER BY s.pos LIMIT 1) x
)
SELECT {out} FROM s ASOF JOIN w ON s.pos >= w.start
"""


@query(
    _one_pass(
        "SELECT row_number() OVER (ORDER BY md5('7' || chr(0) || source || chr(0) || doc_id), source, doc_id) - 1 AS pos, doc_id AS key, coalesce(octet_length(encode(text)), 0) AS bytes, 1 AS rows FROM documents",
        60_000,
        40,
        "key AS doc_id, CAST(shard AS BIGINT) AS shard, CAST(pos - start AS BIGINT) AS place",
    )
)
def packed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a seeded order, packed into shards by bytes and rows."""
    d = t(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), ordering.shuffle_key(7, F.col("source"), F.col("doc_id")).alias("h"))
    placed = ordering.with_hash_index(d, "h", "source", "doc_id", name="at")
    return placed.select("at", "doc_id").join(packing.packed(placed, "at", "bytes", 60_000, 40), "at").select("doc_id", "shard", "place")


@query(
    _one_pass(
        "SELECT row_number() OVER (ORDER BY min(l_shipdate), l_orderkey) - 1 AS pos, l_orderkey AS key, sum(CAST(l_quantity AS BIGINT)) AS bytes, count(*) AS rows FROM lineitem GROUP BY l_orderkey",
        5_000,
        150,
        "key AS l_orderkey, CAST(shard AS BIGINT) AS shard, CAST(pos - start AS BIGINT) AS place",
    )
)
def packed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their first shipping, whole, packed into shards by quantity and lines."""
    d = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", F.col("l_quantity").cast("long").alias("q"))
    return packing.packed_groups(d, "l_orderkey", "l_shipdate", "q", 5_000, 150)


# ---- near hashes and what they leave -----------------------------------------------------------------------------

#: A text as a row of 65 pixels, each the number of times it has a character, and their differences as a hash of 64 bits.
_PIXELS = "etaoinshrdlcumwfgypbvkjxqzETAOINSHRDLCUMWFGYPBVKJXQZ0123456789.,-"
_COUNT = "(length(text) - length(replace(text, '{0}', '')))"
_TEXT_HASHES = f"""h AS MATERIALIZED (
  SELECT doc_id, source, text, CAST(b - CASE WHEN b >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END AS BIGINT) AS bits, [length(text) / 10.0::DOUBLE, p[1]::DOUBLE, p[2]::DOUBLE] AS means FROM (
    SELECT *, list_sum(list_transform(generate_series(1, 64), lambda k: CASE WHEN p[k] > p[k + 1] THEN (1::HUGEINT << (k - 1)::INT) ELSE 0::HUGEINT END)) AS b FROM (
      SELECT doc_id, source, text, [{", ".join(_COUNT.format(c) for c in _PIXELS)}] AS p FROM documents WHERE text IS NOT NULL)))"""
_NEAR = "bit_count(xor(x.bits, y.bits)) <= 4 AND len(list_filter(list_zip(x.means, y.means), lambda m: abs(m[1] - m[2]) >= 12)) = 0"


@F.pandas_udf(ArrayType(LongType()))  # a type by name would need a session
def _pixel_counts(texts: pd.Series) -> pd.Series:
    """How often a text has each of the pixels' characters, all of which are single bytes of UTF-8."""
    codes = np.frombuffer(_PIXELS.encode(), dtype=np.uint8)
    return pd.Series([np.bincount(np.frombuffer(x.encode(), dtype=np.uint8), minlength=256)[codes] for x in texts], dtype=object)


def text_hashes(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """(doc_id, source, bits, means): hashes of texts as of rows of pixels, with more columns of the texts."""
    d = t(spark, sf_dir, "documents").where("text is not null")
    d = d.select("doc_id", "source", F.length("text").alias("n"), _pixel_counts("text").alias("p"), *(c.alias(k) for k, c in more.items()))
    one = F.array(*(F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long") for x in (1 << k for k in range(64))))
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, k: a.bitwiseOR(F.when(F.get("p", k) > F.get("p", k + 1), F.get(one, k)).otherwise(F.lit(0).cast("long"))))
    means = F.array(F.col("n") / F.lit(10.0), F.get("p", F.lit(0)).cast("double"), F.get("p", F.lit(1)).cast("double"))
    # saved, as what follows asks for the hashes again and again
    return Scratch(spark).saved(d.select("doc_id", "source", bits.alias("bits"), means.alias("means"), *more))


@query(
    f"""
WITH {_TEXT_HASHES}, c AS (SELECT source, bits, means, min(doc_id) AS k FROM h GROUP BY ALL)
SELECT x.k AS a, y.k AS b, CAST(bit_count(xor(x.bits, y.bits)) AS INT) AS distance FROM c x JOIN c y ON x.k < y.k AND x.source <> y.source AND {_NEAR}
"""
)
def near_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near hashes of different sources."""
    return pairing.near_images(text_hashes(spark, sf_dir), "doc_id", "source", "bits", "means")


@query(
    f"""
WITH RECURSIVE {_TEXT_HASHES}, d AS MATERIALIZED (
  SELECT doc_id, md5(text) AS pixels, substr(text, 1, 24) AS head, source, CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) NOT BETWEEN 5 AND 3000 THEN 'word_budget' END AS why, bits, means, row_number() OVER (ORDER BY doc_id) AS r
  FROM h
), e AS MATERIALIZED (
  SELECT y.r, y.doc_id, y.why, coalesce(list(x.r) FILTER (x.head = y.head), []) AS g, coalesce(list(x.r) FILTER (x.pixels = y.pixels), []) AS p, coalesce(list(x.r) FILTER ({_NEAR}), []) AS n
  FROM d y LEFT JOIN d x ON x.r < y.r AND x.why IS NULL AND y.why IS NULL AND (x.head = y.head OR x.pixels = y.pixels OR {_NEAR}) GROUP BY ALL
), w AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS got, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS reason
  UNION ALL
  SELECT e.r, CASE WHEN v.reason IS NULL THEN list_append(w.got, e.r) ELSE w.got END, e.doc_id, v.reason
  FROM w JOIN e ON e.r = w.r + 1, LATERAL (SELECT CASE WHEN e.why IS NOT NULL THEN e.why WHEN list_has_any(w.got, e.g) THEN 'same_head' WHEN list_has_any(w.got, e.p) THEN 'same_pixels' WHEN list_has_any(w.got, e.n) THEN 'near' END AS reason) v
)
SELECT doc_id, reason IS NULL AS taken, reason FROM w WHERE r > 0
"""
)
def selected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order, each taken unless an earlier taken one shares its beginning or text, or is near it."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    why = F.when(~words.between(5, 3000), "word_budget")
    d = text_hashes(spark, sf_dir, why=why, head=F.substring("text", 1, 24), pixels=F.md5(F.col("text").cast("binary")))
    d = d.withColumn("same", F.md5(F.to_json(F.struct("bits", "means")).cast("binary")))
    # rows of one hash are a class, named by the least of them
    classes = Scratch(spark).saved(d.groupBy("same").agg(F.min("doc_id").alias("c"), F.first("bits").alias("bits"), F.first("means").alias("means")))

    def near(left: DataFrame, right: DataFrame | None) -> DataFrame:
        return pairing.near_pairs(classes.join(left, "c"), None if right is None else classes.join(right, "c"), "c", None, "bits", "means")

    out = selection.select_first(d.join(classes.select("same", "c"), "same"), ["doc_id"], F.col("why"), {"same_head": F.col("head"), "same_pixels": F.col("pixels")}, key="doc_id", near=("near", "c", near))
    return out.select("doc_id", "taken", "reason")


# ---- keys and draws that SQL cannot make; they are tested against plain Python -----------------------------------


@query()
def blake2b_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the seeded order of 128-bit keys."""
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.concat(F.lit("shards/"), F.col("doc_id") % 100, F.lit(".tar")).alias("shard"), F.col("doc_id").cast("string").alias("key"))
    return blake2.shuffled(d, 42, "lang", "source", "shard", "key").select("doc_id", "random_key", "idx")


@query()
def blake2b_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split by shares of their ids that stay as the table grows."""
    return blake2.stable_split(t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, 0.1)


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether orders are worth more than their lines' list prices, by clusters of customers."""
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("list"))
    d = t(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_totalprice", "list")
    return metrics.paired_bootstrap(d, "o_custkey", "o_totalprice", "list", draws=400)


_FRACTION = "({0} * 37 % 101) / CAST(101 AS DOUBLE)"


@query(
    f"""
WITH a AS (SELECT l_orderkey AS structure, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS atom, {_FRACTION.format("l_partkey")} AS x, {_FRACTION.format("l_suppkey")} AS y, {_FRACTION.format("CAST(l_quantity AS BIGINT)")} AS z FROM lineitem),
l AS (SELECT o_orderkey AS structure, 4.5::DOUBLE + o_custkey % 7 AS w, (o_custkey % 3)::DOUBLE AS skew FROM orders),
m AS (SELECT p.structure, p.atom, q.atom AS neighbour, q.x + i - p.x AS dx, q.y + j - p.y AS dy, q.z + k - p.z AS dz, w, skew FROM a p JOIN a q USING (structure) JOIN l USING (structure), generate_series(-1, 1) AS gi(i), generate_series(-1, 1) AS gj(j), generate_series(-1, 1) AS gk(k)),
d AS (SELECT *, sqrt((dx * w + dy * skew) ** 2 + (dy * w) ** 2 + (dz * w) ** 2) AS distance FROM m)
SELECT structure, atom, CAST(count(*) AS BIGINT) AS neighbours, round(min(distance), 6) AS nearest, round(sum(distance), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY structure, atom ORDER BY distance) AS r FROM d WHERE distance <= 3 AND distance > 1e-8) WHERE r <= 6 GROUP BY ALL
"""
)
def crystal_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as crystals whose lines are atoms: neighbours within 3, six an atom."""
    fraction = lambda c: (F.col(c).cast("long") * 37 % 101) / F.lit(101.0)
    d = t(spark, sf_dir, "lineitem").withColumn("row", F.col("_metadata.row_index"))  # lines that tie keep the table's order, as in the SQL
    place = Window.partitionBy("l_orderkey").orderBy(*(F.asc_nulls_last(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "row", "l_quantity")))
    atoms = d.select(F.col("l_orderkey").alias("structure"), F.row_number().over(place).cast("long").alias("atom"), *(fraction(c).alias(a) for c, a in (("l_partkey", "x"), ("l_suppkey", "y"), ("l_quantity", "z"))))
    w, skew, none = F.lit(4.5) + F.col("o_custkey") % 7, (F.col("o_custkey") % 3).cast("double"), F.lit(0.0)
    lattices = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("structure"), F.array(w, none, none).alias("a"), F.array(skew, w, none).alias("b"), F.array(none, none, w).alias("c"))
    near = crystals.crystal_neighbours(atoms, lattices, cutoff=3.0, most=6)
    return near.groupBy("structure", "atom").agg(F.count(F.lit(1)).alias("neighbours"), F.round(F.min("distance"), 6).alias("nearest"), F.round(F.sum("distance"), 4).alias("total"))
