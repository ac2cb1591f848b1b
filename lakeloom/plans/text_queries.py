"""Queries for captions, series, options, rewards and grouped draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import samples as S
from lakeloom.functions import text as T
from lakeloom.operators import sampling
from lakeloom.plans.queries import query, t


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Image.' WHEN 1 THEN 'Image.' WHEN 2 THEN lang ELSE source END AS caption, CASE doc_id % 4 WHEN 1 THEN NULL WHEN 2 THEN lang ELSE source END AS first FROM documents")
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    a, b = F.when(k == 1, " \t").when(k == 2, F.col("lang")), F.when(k == 3, F.col("source"))
    return t(spark, sf_dir, "documents").select("doc_id", T.caption(a, b).alias("caption"), S.first_text(a, F.when(k != 1, F.col("source"))).alias("first"))


@query(
    """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, CAST(5 AS BIGINT) AS width, CAST(CASE WHEN vec_id % 2 = 0 THEN 5 ELSE 3 END AS BIGINT) AS rows, round(v[2], 6) AS cell, round(v[1] + v[2] + list_sum(v[1:5]), 6) AS total FROM e
"""
)
def ragged_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ragged rows of each vector made a rectangle, and turned upright where they are wide."""
    v = F.col("embedding").cast("array<double>")
    rect = S.rectangle(F.array(F.slice(v, 1, 2), F.slice(v, 1, 0), F.slice(v, 1, 5)))
    shape = F.when(F.col("vec_id") % 2 == 0, S.upright(F.col("r"))).otherwise(F.col("r"))
    d = t(spark, sf_dir, "embeddings").select("vec_id", rect.alias("r")).withColumn("s", shape)
    cell = F.when(F.col("vec_id") % 2 == 0, F.col("s")[1][0]).otherwise(F.col("s")[0][1])
    return d.select("vec_id", F.size(F.col("r")[0]).cast("long").alias("width"), F.size("s").cast("long").alias("rows"), F.round(cell, 6).alias("cell"), F.round(F.aggregate(F.flatten("s"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT p_partkey, printf('a <ts> Mean: %.2f, Std: %.2f  b <ts> c', p_retailprice, p_size::DOUBLE) AS text, concat_ws(', ', CASE WHEN p_size % 2 = 0 THEN 'Double Bond' END, CASE WHEN p_size % 3 = 0 THEN 'Ring' END) AS motifs FROM part")
def prompt_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    smiles = F.concat(F.when(F.col("p_size") % 2 == 0, "C=O").otherwise("CC"), F.when(F.col("p_size") % 3 == 0, "C1CC1").otherwise("N"))
    got = S.with_statistics(F.lit("a <ts> b <ts> c"), F.array("p_retailprice"), F.array(F.col("p_size").cast("double")))
    return t(spark, sf_dir, "part").select("p_partkey", got.alias("text"), S.motifs(smiles).alias("motifs"))


@query(
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'B' WHEN 'O' THEN NULL ELSE 'C' END AS option, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS answer FROM orders
"""
)
def options_and_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("o_orderstatus") == "F", "The answer is B, not C.").when(F.col("o_orderstatus") == "O", "Bee or ABBA").otherwise("(C)")
    tagged = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("so <answer>\n"), F.col("o_orderpriority"), F.lit(" </answer> and <answer>x</answer>"))).otherwise("<answer>open")
    return t(spark, sf_dir, "orders").select("o_orderkey", T.option_letter(said).alias("option"), T.between_tags(tagged).alias("answer"))


@query(
    r"""
WITH d AS (SELECT doc_id, text, lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 0.25 ELSE 0 END::DOUBLE AS tags, CASE WHEN n < 10 THEN 0 WHEN n <= 300 THEN 1 WHEN n <= 600 THEN 0.5 ELSE 0 END::DOUBLE AS concise, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0 END::DOUBLE AS correct FROM d
"""
)
def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("doc_id") % 3, F.col("doc_id") % 4
    tagged = F.when(k == 0, "<reasoning>a</reasoning>\n<answer>b</answer>").when(k == 1, "<answer>b</answer><reasoning>a").otherwise("b")
    tagged = F.when(k == 1, "x</answer><reasoning>a").otherwise(tagged)
    said = F.when(c == 0, F.concat(F.lit(" "), F.upper("lang"))).when(c == 1, F.concat(F.lit("it is "), F.col("lang"))).otherwise("no")
    answer = F.when(c != 3, F.when(c == 2, "yes").otherwise(F.col("lang"))).otherwise(" ")
    return t(spark, sf_dir, "documents").select("doc_id", T.tag_reward(tagged).alias("tags"), T.concise_reward(F.col("text")).alias("concise"), T.correct_reward(said, answer).alias("correct"))


def _u(value: str, seed: int) -> str:
    return f"('0x' || substr(sha256('{seed}:' || {value}), 1, 8))::BIGINT / 4294967296::DOUBLE"


@query(
    f"""
WITH d AS (SELECT range AS draw, range // 16 AS batch FROM range(8000)), g AS (SELECT draw, batch, CAST(floor({_u("batch", 9)} * 2) AS INT) AS k, {_u("draw", 7)} AS u, {_u("draw", 8)} AS v FROM d)
SELECT draw, CAST(batch AS BIGINT) AS batch, CASE k WHEN 0 THEN 'image' ELSE 'text' END AS "group", CASE WHEN k = 0 THEN CASE WHEN u < 0.25 THEN 'a' ELSE 'b' END ELSE 'c' END AS dataset, CAST(floor(v * CASE WHEN k = 0 THEN CASE WHEN u < 0.25 THEN 10 ELSE 20 END ELSE 30 END) AS BIGINT) AS place FROM g
"""
)
def grouped_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred batches of sixteen draws: modalities evenly, their datasets by weight."""
    return sampling.grouped_draws(spark, {"image": [("a", 1.0, 10), ("b", 3.0, 20)], "text": [("c", 2.0, 30)]}, 500, 16, 7)


@query("SELECT month, count(*)::BIGINT AS n FROM (SELECT month(o_orderdate)::INT AS month FROM orders UNION ALL SELECT month(l_shipdate)::INT FROM lineitem) WHERE month IN (SELECT month(o_orderdate) FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT month(l_shipdate) FROM lineitem WHERE l_linenumber = 7) GROUP BY month")
def shared_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables' rows, for the months that both have under a condition."""
    o, lines = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    month = lambda df, c: df.select(F.month(c).alias("month"))
    both = month(o.where("o_orderstatus = 'P'"), "o_orderdate").intersect(month(lines.where("l_linenumber = 7"), "l_shipdate"))
    return month(o, "o_orderdate").unionByName(month(lines, "l_shipdate")).join(both, "month", "left_semi").groupBy("month").agg(F.count(F.lit(1)).alias("n"))
