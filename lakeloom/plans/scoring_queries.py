"""Queries for scores of predictions, rewards, traces and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators import scoring
from lakeloom.plans.queries import _GUESS, _guesses, next_turn_pairs, query, r6, t


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n).cast("double")) for n in names})


_TAGGED = f"(SELECT g.*, CAST(guess AS VARCHAR) AS said, contains(text, '.') AS formatted, length(text) < 100 AS forced FROM {_GUESS} g JOIN documents USING (doc_id))"


@query(
    f"""
SELECT CAST(count(*) AS BIGINT) AS n, round(avg((quality = guess)::INT), 6) AS accuracy, round(avg(formatted::INT), 6) AS format_rate, round(avg(forced::INT), 6) AS forced_rate,
  round((SELECT max(c) FROM (SELECT count(*) AS c FROM {_TAGGED} GROUP BY quality)) / count(*)::DOUBLE, 6) AS majority_baseline FROM {_TAGGED}
"""
)
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _guesses(spark, sf_dir).join(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    got = scoring.summary(d, "quality", "guess", F.contains("text", F.lit(".")), F.length("text") < 100)
    return _rounded(got, "accuracy", "format_rate", "forced_rate", "majority_baseline")


@query(f"SELECT quality, CAST(count(*) AS BIGINT) AS n, CAST(sum((quality = guess)::INT) AS BIGINT) AS correct FROM {_GUESS} GROUP BY quality")
def correct_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.per_truth(_guesses(spark, sf_dir), "quality", "guess")


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax, round(avg(l_quantity), 6) AS l_quantity FROM lineitem")
def mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.mean_scores(t(spark, sf_dir, "lineitem"), "l_discount", "l_tax", "l_quantity"), "l_discount", "l_tax", "l_quantity")


_JUDGED = "(l_linenumber % 3) * 0.5::DOUBLE"


@query(
    f"""
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(sum(({_JUDGED} = 1)::INT) AS BIGINT) AS correct, CAST(sum(({_JUDGED} = 0.5)::INT) AS BIGINT) AS partial, CAST(sum(({_JUDGED} = 0)::INT) AS BIGINT) AS incorrect,
  round(avg(({_JUDGED} = 1)::INT), 6) AS correct_share, round(avg(({_JUDGED} = 0.5)::INT), 6) AS partial_share, round(avg(({_JUDGED} = 0)::INT), 6) AS incorrect_share FROM lineitem GROUP BY l_returnflag
"""
)
def judge_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 3 * F.lit(0.5)).alias("score"))
    return _rounded(scoring.judged(d, "score", "l_returnflag"), "correct_share", "partial_share", "incorrect_share")


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(avg(abs(c_acctbal - c_custkey)), 4) AS mae FROM customer GROUP BY c_mktsegment")
def absolute_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scoring.mean_absolute_error(t(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", "c_mktsegment")
    return got.withColumn("mae", F.round("mae", 4))


@query(
    """
WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity AS truth, l_discount * 300 AS said FROM lineitem), s AS (SELECT l_orderkey, avg(abs(said - truth)) AS mae, count(*) AS steps FROM o WHERE l_linenumber <= 4 GROUP BY l_orderkey)
SELECT CAST(count(*) AS BIGINT) AS series, round(avg(mae), 6) AS mae, CAST(sum(steps) AS BIGINT) AS steps FROM s
"""
)
def horizon_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series: an order's lines, of which a forecast has four at most; the mean of the series' means."""
    line = F.struct("l_linenumber", F.col("l_quantity").alias("truth"), (F.col("l_discount") * 300).alias("said"))
    d = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("ls"))  # the lines of one order
    d = d.select("l_orderkey", F.transform(F.filter("ls", lambda x: x["l_linenumber"] <= 4), lambda x: x["said"]).alias("said"), F.col("ls.truth").alias("truth"))
    per = scoring.horizon_error(d, "l_orderkey", "said", "truth").where("mae is not null")
    return per.agg(F.count(F.lit(1)).alias("series"), r6(F.avg("mae")).alias("mae"), F.sum("steps").cast("long").alias("steps"))


_GRAMS = "list_transform(range(1, len({0}) - {1} + 1), lambda i: array_to_string(list_slice({0}, i, i + {1}), chr(31)))"
_PAIRS = "(SELECT conv_id, turn, list_filter(regexp_split_to_array(next_text, '\\s+'), lambda w: w <> '') AS p, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS t FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_text FROM conversations) WHERE next_text IS NOT NULL)"


@query(
    f"""
WITH r AS (SELECT *, row_number() OVER () AS id FROM {_PAIRS}),
g AS (SELECT id, 1 AS k, unnest(p) AS g, 1 AS side FROM r UNION ALL SELECT id, 1, unnest(t), 2 FROM r UNION ALL SELECT id, 2, unnest({_GRAMS.format("p", 1)}), 1 FROM r UNION ALL SELECT id, 2, unnest({_GRAMS.format("t", 1)}), 2 FROM r),
c AS (SELECT id, k, g, sum((side = 1)::INT) AS a, sum((side = 2)::INT) AS b FROM g GROUP BY ALL),
s AS (SELECT sum(CASE WHEN k = 1 THEN least(a, b) END) AS s1, sum(CASE WHEN k = 2 THEN least(a, b) END) AS s2 FROM c),
m AS (SELECT count(*) AS n, sum(len(p)) AS np, sum(len(t)) AS nt, sum(len(p)) AS m1, sum(greatest(len(p) - 1, 0)) AS m2 FROM r)
SELECT CAST(n AS BIGINT) AS n, round(CASE WHEN s1 > 0 AND s2 > 0 THEN exp((ln(s1 / m1::DOUBLE) + ln(s2 / m2::DOUBLE)) / 2 + CASE WHEN np > nt THEN 0 ELSE 1 - nt / np::DOUBLE END) ELSE 0 END, 6) AS bleu FROM m, s
"""
)
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's next one against it, up to pairs of words."""
    return _rounded(scoring.corpus_bleu(next_turn_pairs(spark, sf_dir), F.col("next_text"), F.col("text"), 2), "bleu")


_PLAIN = r"regexp_replace(lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}_\s]', '', 'g')), '^\s+|\s+$', '', 'g')"


@query(
    f"""
WITH r AS (SELECT lang, text AS p, CASE doc_id % 3 WHEN 0 THEN text || '!' WHEN 1 THEN left(text, 5) ELSE 'Zq ' || text END AS t FROM documents), c AS (SELECT *, {_PLAIN.format("p")} AS pp, {_PLAIN.format("t")} AS tt FROM r)
SELECT lang, CAST(count(*) AS BIGINT) AS n, round(avg(coalesce((pp = tt)::INT, 0)), 6) AS exact, round(avg(coalesce((tt <> '' AND contains(pp, tt))::INT, 0)), 6) AS containment,
  round(avg(coalesce((nullif(regexp_extract(p, '\\b([A-D])\\b', 1), '') = nullif(regexp_extract(t, '\\b([A-D])\\b', 1), ''))::INT, 0)), 6) AS option FROM c GROUP BY lang
"""
)
def answer_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").withColumn("t", F.expr("CASE doc_id % 3 WHEN 0 THEN text || '!' WHEN 1 THEN left(text, 5) ELSE 'Zq ' || text END"))
    return _rounded(scoring.answer_rates(d, F.col("text"), F.col("t"), "lang"), "exact", "containment", "option")


_SHAPES = "{0}.doc_id, starts_with(lower({0}.text), 'e')::INT::DOUBLE AS opens, (length({0}.text) BETWEEN 10 AND 300)::INT::DOUBLE AS concise, (length({0}.text) - length(replace({0}.text, '.', ''))) * 0.125::DOUBLE AS dots"


@query(
    f"""
WITH s AS (SELECT lang, {_SHAPES.format("d")} FROM documents d), r AS (SELECT lang, 'opens' AS reward, opens AS score FROM s UNION ALL SELECT lang, 'concise', concise FROM s UNION ALL SELECT lang, 'dots', dots FROM s UNION ALL SELECT lang, 'mean', (opens + concise + dots) / 3 FROM s)
SELECT lang, reward, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min, round(max(score), 6) AS max, CAST(sum((score > 0)::INT) AS BIGINT) AS successes FROM r GROUP BY lang, reward
"""
)
def reward_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    d = t(spark, sf_dir, "documents").select("lang", F.startswith(F.lower(c), F.lit("e")).cast("double").alias("opens"), F.length(c).between(10, 300).cast("double").alias("concise"), ((F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))) * 0.125).alias("dots"))
    return _rounded(scoring.reward_breakdown(d, ["opens", "concise", "dots"], "lang"), "mean", "std", "max")


@query(
    """
WITH o AS (SELECT l_orderkey, list(l_partkey % 5 ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, list(l_suppkey % 5 ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem GROUP BY l_orderkey), m AS (SELECT l_orderkey, len(list_filter(range(1, least(len(a), len(b), 4) + 1), lambda i: a[i] = b[i])) AS matches FROM o)
SELECT l_orderkey, CAST(matches AS INT) AS matches, matches >= 2 AS passed FROM m
"""
)
def token_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    d = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("ls"))  # the lines of one order
    d = d.select("l_orderkey", F.transform("ls", lambda x: x["l_partkey"] % 5).alias("a"), F.transform("ls", lambda x: x["l_suppkey"] % 5).alias("b"))
    return scoring.token_parity(d, "a", "b", 4, 2).select("l_orderkey", "matches", "passed")


@query(
    """
WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, 'f32' AS kind FROM embeddings WHERE vec_id % 11 <> 0),
b AS (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN list_transform(embedding, lambda x: x::DOUBLE + 0.25::DOUBLE) WHEN 1 THEN list_transform(embedding[1:3], lambda x: x::DOUBLE) WHEN 2 THEN list_transform(embedding, lambda x: 'nan'::DOUBLE) ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS v, CASE WHEN vec_id % 5 = 3 THEN 'f16' ELSE 'f32' END AS kind FROM embeddings WHERE vec_id % 13 <> 0),
j AS (SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, a.v AS x, b.v AS y, a.kind AS ka, b.kind AS kb FROM a FULL JOIN b ON a.vec_id = b.vec_id)
SELECT vec_id, CASE WHEN x IS NULL OR y IS NULL THEN 'missing' WHEN len(x) <> len(y) OR ka <> kb THEN 'shape' WHEN vec_id % 5 = 2 THEN 'nonfinite' WHEN vec_id % 5 = 0 THEN 'mismatch' ELSE 'passed' END AS verdict,
  round(CASE WHEN x IS NULL OR y IS NULL OR len(x) <> len(y) OR ka <> kb OR vec_id % 5 = 2 THEN NULL WHEN vec_id % 5 = 0 THEN 0.25 ELSE 0 END, 6)::DOUBLE AS max_abs FROM j
"""
)
def trace_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors against copies that are moved, cut, not finite or of another kind."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.lit("f32").alias("kind"))
    k = F.col("vec_id") % 5
    moved = F.when(k == 0, F.transform("v", lambda x: x + 0.25)).when(k == 1, F.slice("v", 1, 3)).when(k == 2, F.transform("v", lambda x: F.lit(float("nan")))).otherwise(F.col("v"))
    other = e.where("vec_id % 13 <> 0").select("vec_id", moved.alias("v"), F.when(k == 3, "f16").otherwise("f32").alias("kind"))
    return _rounded(scoring.trace_report(e.where("vec_id % 11 <> 0"), other, "vec_id", "v", "kind", 1e-6), "max_abs")


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS pairs, round(avg(l_discount), 6) AS matched_loss, round(avg(l_tax), 6) AS wrong_loss, round(avg(l_tax - l_discount), 6) AS wrong_minus_matched, CAST(sum((l_discount < l_tax)::INT) AS BIGINT) AS matched_wins FROM lineitem GROUP BY ALL")
def paired_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scoring.paired_control(t(spark, sf_dir, "lineitem"), "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return _rounded(got, "matched_loss", "wrong_loss", "wrong_minus_matched")


@query("SELECT p_brand, p_type, CAST(count(*) AS BIGINT) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS std, round(stddev_samp(p_retailprice) / abs(avg(p_retailprice)), 6) AS relative FROM part GROUP BY ALL")
def seed_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.replicas(t(spark, sf_dir, "part"), "p_retailprice", "p_brand", "p_type"), "mean", "std", "relative")


_POISSON = [0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182, 0.999916758851, 0.999989750803, 0.999998874797, 0.999999888575, 0.999999989952, 0.999999999169]


@query(
    f"""
WITH c AS (SELECT user_id, sum(value) AS s, count(value) AS n FROM events GROUP BY user_id), d AS (SELECT unnest(range(200)) AS draw),
u AS (SELECT draw, s, n, ('0x' || substr(md5('0:' || draw || ':' || user_id), 1, 8))::BIGINT / 4294967295::DOUBLE AS u FROM c CROSS JOIN d),
m AS (SELECT sum(k * s) / sum(k * n) AS m FROM (SELECT *, {" + ".join(f"(u >= {x}::DOUBLE)::INT" for x in _POISSON)} AS k FROM u) GROUP BY draw HAVING sum(k * n) > 0)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM c) AS clusters, round((SELECT sum(s) / sum(n) FROM c), 6) AS mean, round(quantile_cont(m, 0.025::DOUBLE), 6) AS low, round(quantile_cont(m, 0.975::DOUBLE), 6) AS high FROM m
"""
)
def mean_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.mean_interval(t(spark, sf_dir, "events"), "user_id", "value"), "mean", "low", "high")


@query(
    """
WITH f AS (SELECT p_brand, avg(p_size) + 30 * (p_brand LIKE '%7')::INT AS vertex, min(p_retailprice) - 100 * (p_brand LIKE '%3')::INT - 5000 * (p_brand LIKE '%5')::INT AS predicted FROM part GROUP BY p_brand), s AS (SELECT p_brand, min(p_size) AS x0, max(p_size) AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM part GROUP BY p_brand)
SELECT p_brand, round(vertex, 6) AS vertex, round(predicted, 6) AS predicted, vertex BETWEEN x0 AND x1 AND predicted BETWEEN y0 - (y1 - y0) * 0.5 AND y1 + (y1 - y0) * 0.5 AS trusted FROM f JOIN s USING (p_brand)
"""
)
def trusted_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    ends = lambda d: F.col("p_brand").endswith(d).cast("int")
    fits = p.groupBy("p_brand").agg(F.avg("p_size").alias("v"), F.min("p_retailprice").alias("m")).select("p_brand", (F.col("v") + 30 * ends("7")).alias("vertex"), (F.col("m") - 100 * ends("3") - 5000 * ends("5")).alias("predicted"))
    return _rounded(scoring.trusted_vertices(p, fits, "p_brand", "p_size", "p_retailprice"), "vertex", "predicted")


@query(
    """
WITH s AS (SELECT l_returnflag, count(*) AS steps, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, CAST(steps AS BIGINT) AS steps, round(a, 6) AS l_quantity, round(b, 6) AS l_discount, round(c, 6) AS l_tax, round(a / (a + b + c), 6) AS l_quantity_share, round(b / (a + b + c), 6) AS l_discount_share, round(c / (a + b + c), 6) AS l_tax_share, round(256 / (a + b + c), 6) AS throughput FROM s
"""
)
def step_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["l_quantity", "l_discount", "l_tax"]
    got = scoring.step_shares(t(spark, sf_dir, "lineitem"), parts, "l_returnflag", items=256)
    return _rounded(got, *parts, *(f"{p}_share" for p in parts), "throughput")


@query(
    """
WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE value::VARCHAR END AS v, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, CAST(count(CASE WHEN k > 10 OR c <= 10 THEN try_cast(v AS DOUBLE) END) AS BIGINT) AS n, round(avg(CASE WHEN k > 10 OR c <= 10 THEN try_cast(v AS DOUBLE) END), 6) AS mean, round(arg_max(value, event_id), 6) AS last FROM r GROUP BY user_id
"""
)
def after_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("v"), F.col("value").cast("string").alias("run"))
    return _rounded(scoring.after_warmup(d, "user_id", "event_id", "v", "run", 10), "mean", "last")


@query(
    """
WITH g AS (SELECT source, lang, count(*) AS n, sum(length(text)) AS c FROM documents GROUP BY ALL)
SELECT CAST(count(*) AS BIGINT) AS datasets, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(ceil(n / 100::DOUBLE)) AS BIGINT) AS shards FROM g
"""
)
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("datasets"), F.sum("n").alias("samples"), F.sum(F.ceil(F.col("n") / 100)).cast("long").alias("shards"))


@query(
    r"""
SELECT CAST(doc_id // 64 AS BIGINT) AS batch, lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''))) AS BIGINT) AS tokens FROM documents GROUP BY ALL
"""
)
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and tokens that are no padding, by batch and language."""
    d = t(spark, sf_dir, "documents")
    return d.groupBy(F.floor(F.col("doc_id") / 64).cast("long").alias("batch"), "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(T.word_count(F.col("text"))).alias("tokens"))


@query(
    """
SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS priorities FROM orders GROUP BY o_orderstatus
"""
)
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"))
