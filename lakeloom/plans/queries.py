"""Queries that apply the operators to the tables, each over whole tables, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators import audit, curation, metrics, mixture, ordering, telemetry
from lakeloom.operators.sampling import ranked_in_group, running_in_group

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# ---- lengths, buckets, batches -----------------------------------------------------------------------------------

_WORDS = r"len(list_filter(regexp_split_to_array(coalesce({0}, ''), '\s+'), lambda x: x <> ''))"


@query(
    """
WITH d AS (SELECT source, length(text) // 4 AS tokens, row_number() OVER (PARTITION BY source ORDER BY length(text) // 4) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(min(tokens) AS BIGINT) AS min_tokens, CAST(max(tokens) AS BIGINT) AS max_tokens, round(avg(tokens), 6) AS mean_tokens,
  CAST(max(CASE WHEN r = floor(n * 0.5::DOUBLE) THEN tokens END) AS BIGINT) AS median_tokens, CAST(max(CASE WHEN r = floor(n * 0.9::DOUBLE) THEN tokens END) AS BIGINT) AS p90_tokens,
  CAST(max(CASE WHEN r = floor(n * 0.99::DOUBLE) THEN tokens END) AS BIGINT) AS p99_tokens FROM d GROUP BY source
"""
)
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("source", F.floor(F.length("text") / 4).cast("long").alias("tokens"))
    ranks = ordering.nearest_ranks(d, ["source"], "tokens", {"median_tokens": 0.5, "p90_tokens": 0.9, "p99_tokens": 0.99})
    own = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"), r6(F.avg("tokens")).alias("mean_tokens"))
    return own.join(ranks, "source")


@query(
    """
WITH d AS (SELECT lang, CAST(length(text) AS DOUBLE) AS n FROM documents)
SELECT lang, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS longest, round((max(n) * count(*) - sum(n)) / (max(n) * count(*)), 6) AS padding FROM d GROUP BY lang
"""
)
def sequence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("lang", F.length("text").cast("double").alias("n"))
    counts = d.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("times"))
    cells = F.max("n") * F.sum("times")
    p = lambda q: r6(F.expr(f"percentile(n, {q}, times)"))
    return counts.groupBy("lang").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.max("n").alias("longest"), r6((cells - F.sum(F.col("n") * F.col("times"))) / cells).alias("padding"))


@query(
    """
WITH d AS (SELECT lang, length(text) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch FROM documents),
b AS (SELECT lang, batch, sum(n) AS kept, max(n) * count(*) AS cells, count(*) AS k FROM d GROUP BY lang, batch)
SELECT lang, CAST(count(*) AS BIGINT) AS batches, CAST(sum(k) AS BIGINT) AS rows, round(sum(kept) / sum(cells)::DOUBLE, 6) AS efficiency, round(min(kept / cells::DOUBLE), 6) AS least, round(max(kept / cells::DOUBLE), 6) AS most, CAST(sum(cells) - sum(kept) AS BIGINT) AS wasted FROM b GROUP BY lang
"""
)
def padding_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ordering.with_index(t(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("n")), "doc_id")
    return ordering.padding(d.withColumn("batch", F.floor(F.col("idx") / 8)), "batch", "n", "lang")


@query(
    """
WITH d AS (SELECT doc_id, length(text) AS len, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents),
b AS (SELECT *, idx // 100 AS buffer FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY buffer ORDER BY len, idx) - 1 AS r, count(*) OVER (PARTITION BY buffer) AS n FROM b)
SELECT doc_id, CAST(buffer AS BIGINT) AS buffer, CAST(CASE WHEN n < 8 THEN 0 ELSE least(r // (n // 8), 7) END AS BIGINT) AS bucket FROM r
"""
)
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ordering.with_index(t(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("len")), "doc_id")
    return ordering.length_buckets(d, "idx", "len", 100, 8).select("doc_id", "buffer", "bucket")


@query(
    """
WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders)
SELECT o_orderkey, o_custkey, CAST(place AS BIGINT) AS place FROM o
"""
)
def longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (-F.col("o_totalprice")).alias("cost"))
    return ranked_in_group(d, "o_custkey", "cost", "o_orderkey").select("o_orderkey", "o_custkey", F.col("rank").cast("long").alias("place"))


# ---- mixtures ----------------------------------------------------------------------------------------------------


@query(
    """
WITH d AS (SELECT source, count(*) AS samples, sum(length(text)) AS chars FROM documents GROUP BY source), w AS (SELECT *, sqrt(samples) AS weight FROM d)
SELECT source, CAST(samples AS BIGINT) AS samples, round(weight / sum(weight) OVER (), 6) AS share, round(10000 * weight / sum(weight) OVER (), 6) AS expected,
  round(10000 * weight / sum(weight) OVER () / samples, 6) AS passes, round(max(samples * (SELECT sum(sqrt(samples)) FROM d) / weight) OVER (), 6) AS full_pass FROM w
"""
)
def mixture_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("samples")).withColumn("weight", F.sqrt("samples"))
    return mixture.coverage(d, 10_000).select("source", "samples", r6("share").alias("share"), r6("expected").alias("expected"), r6("passes").alias("passes"), r6("full_pass").alias("full_pass"))


@query(
    """
WITH d AS (SELECT lang, source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY lang, source)
SELECT lang, source, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM d
"""
)
def weights_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return mixture.shares(d, "n", ["lang"]).select("lang", "source", r6("share").alias("share"))


@query(
    """
WITH d AS (SELECT source AS dataset, lang AS "group", count(*) AS n, source = 'src3' AS skip FROM documents GROUP BY source, lang),
a AS (SELECT * FROM d WHERE "group" IN ('en', 'fr') AND NOT skip),
w AS (SELECT dataset, "group", CASE dataset WHEN 'src1' THEN 2.5 WHEN 'src2' THEN 0 WHEN 'src0' THEN 0.5 ELSE 1 END AS weight, CASE dataset WHEN 'src1' THEN 0.25 ELSE 1 END AS proportion, n FROM a)
SELECT dataset, "group", CAST(weight AS DOUBLE) AS weight, CAST(CASE WHEN proportion < 1 THEN greatest(1, floor(n * proportion)) ELSE n END AS BIGINT) AS kept FROM w WHERE weight > 0
"""
)
def mixture_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").groupBy(F.col("source").alias("dataset"), F.col("lang").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumns({"weight": F.lit(None).cast("double"), "proportion": F.lit(None).cast("double"), "skip": F.col("dataset") == "src3"})
    preset = spark.createDataFrame([("en",), ("fr",), ("nowhere",)], "group string")
    rows = [("src1", 3.0, 0.25, 1), ("src1", 2.5, None, 2), ("src2", 0.0, None, 2), ("src0", 0.5, None, 1)]
    overrides = spark.createDataFrame(rows, "dataset string, weight double, proportion double, level int")
    got = mixture.resolve(d, preset, overrides)
    return got.select("dataset", "group", "weight", mixture.prefix_count(F.col("n"), F.col("proportion")).alias("kept"))


@query(
    """
WITH c AS (SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality)
SELECT concat(lang, ':', quality) AS class, CAST(n AS BIGINT) AS n, round(least(3, sum(n) OVER () / (count(*) OVER () * n)::DOUBLE), 6) AS weight FROM c
"""
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    got = mixture.class_weights(d.withColumn("class", F.concat_ws(":", "lang", F.col("quality").cast("string"))), "class", 3.0)
    return got.withColumn("weight", r6("weight"))


# ---- splits, shards, order ---------------------------------------------------------------------------------------


@query(
    """
SELECT doc_id, CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295::DOUBLE < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents
"""
)
def hash_split_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = ordering.md5_share(F.col("doc_id"))
    return t(spark, sf_dir, "documents").select("doc_id", F.when(share < 0.1, "val").otherwise("train").alias("split"))


@query(
    """
WITH d AS (SELECT doc_id, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM documents)
SELECT doc_id, CASE WHEN u < 0.1 THEN 'val' WHEN u < 0.3 THEN 'test' ELSE 'train' END AS split FROM d
"""
)
def hash_split_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = ordering.sha_share(F.col("doc_id"), 7)
    return t(spark, sf_dir, "documents").select("doc_id", F.when(share < 0.1, "val").when(share < 0.3, "test").otherwise("train").alias("split"))


_LINES = "row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1"


@query(
    f"""
WITH d AS (SELECT l_orderkey, l_linenumber, {_LINES} AS idx FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(idx % 7 AS BIGINT) AS rank, CAST(idx // 1000 AS BIGINT) AS shard, printf('%08d', idx) AS key, CASE WHEN idx < 5000 THEN 'prefix' ELSE 'tail' END AS part FROM d
"""
)
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strided ranks, fixed-count shards, keys and a prefix split over one global order."""
    d = ordering.with_index(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")
    i = F.col("idx")
    return d.select("l_orderkey", "l_linenumber", F.pmod(i, F.lit(7)).alias("rank"), F.floor(i / 1000).cast("long").alias("shard"), F.format_string("%08d", i).alias("key"), F.when(i < 5000, "prefix").otherwise("tail").alias("part"))


@query(
    """
WITH d AS (SELECT o_orderkey, ntile(13) OVER (ORDER BY o_orderkey) - 1 AS shard FROM orders)
SELECT CAST(shard AS BIGINT) AS shard, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM d GROUP BY shard
"""
)
def equal_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "orders").select("o_orderkey")
    shard = ordering.equal_shard(F.col("idx"), d.count(), 13)
    return ordering.with_index(d, "o_orderkey").groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


_KEY = "md5('42' || chr(0) || lang || chr(0) || source || chr(0) || doc_id)"


@query(f"SELECT doc_id, {_KEY} AS key, CAST(row_number() OVER (ORDER BY {_KEY}, doc_id) - 1 AS BIGINT) AS idx FROM documents")
def global_shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ordering.shuffle_key(42, F.col("lang"), F.col("source"), F.col("doc_id"))
    return ordering.with_hash_index(t(spark, sf_dir, "documents").select("doc_id", key.alias("key")), "key", "doc_id")


@query(
    f"""
WITH d AS (SELECT source, row_number() OVER (ORDER BY {_KEY}, doc_id) - 1 AS idx FROM documents),
c AS (SELECT idx // 200 AS w, source, count(*) AS n, min(idx) AS f FROM d GROUP BY w, source),
r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, f) AS rank, n / sum(n) OVER (PARTITION BY w)::DOUBLE AS share FROM c)
SELECT CAST(w AS BIGINT) AS "window", source, CAST(n AS BIGINT) AS n, round(share, 6) AS share, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5
"""
)
def composition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ordering.shuffle_key(42, F.col("lang"), F.col("source"), F.col("doc_id"))
    d = ordering.with_hash_index(t(spark, sf_dir, "documents").select("doc_id", "source", key.alias("key")), "key", "doc_id")
    return audit.composition(d, "idx", 200, "source", 5).withColumn("share", r6("share"))


# ---- conversations and text --------------------------------------------------------------------------------------


@query(
    """
SELECT conv_id, string_agg(role || ': ' || text || chr(10), '' ORDER BY turn, role, text) AS text, '[chat] ' || conv_id AS meta, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY conv_id
"""
)
def chat_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("role", F.lit(": "), "text", F.lit("\n"))
    d = t(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text", line.alias("line")).alias("m"))
    d = d.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))  # the turns of one conversation
    return d.select("conv_id", F.array_join("ms.line", "").alias("text"), F.concat(F.lit("[chat] "), F.col("conv_id").cast("string")).alias("meta"), F.size("ms").cast("long").alias("turns"))


@query(
    """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM conversations)
SELECT conv_id, turn, role, text FROM c WHERE r = 1
"""
)
def last_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return t(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(own)).where("r = 1").select("conv_id", "turn", "role", "text")


_TURNS = "(SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_text FROM conversations)"


@query(f"SELECT conv_id, turn, text, next_text FROM {_TURNS} WHERE next_text IS NOT NULL")
def next_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    d = t(spark, sf_dir, "conversations").withColumn("next_text", F.lead("text").over(own))
    return d.where("next_text is not null").select("conv_id", "turn", "text", "next_text")


@query(
    """
SELECT conv_id, turn, coalesce(lead(text) OVER w, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text)) AS other FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
"""
)
def derangement(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.lead("text").over(own), F.first("text").over(own)).alias("other"))


@query(
    r"""
WITH d AS (SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g')) AS plain, lower(split_part(text, ';', 1)) AS clause, replace(regexp_replace(text, '[\[\]'']', '', 'g'), '_', ' ') AS listed FROM documents)
SELECT doc_id, regexp_replace(plain, '^\s+|\s+$', '', 'g') AS plain, regexp_replace(clause, '^\s+|\s+$', '', 'g') AS clause, regexp_replace(listed, '^\s+|\s+$', '', 'g') AS listed FROM d
"""
)
def answer_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", T.plain_answer(c).alias("plain"), T.first_clause(c).alias("clause"), T.list_answer(c).alias("listed"))


@query(
    rf"""
SELECT doc_id, CAST({_WORDS.format("text")} AS BIGINT) AS words, {_WORDS.format("text")} >= 50 AS long_enough, contains(lower(text), 'the') AND contains(lower(text), 'and') AS keywords, NOT contains(text, '$$$') AS clean,
  CAST(len(regexp_extract_all(text, '\d+')) AS BIGINT) AS numbers FROM documents
"""
)
def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return t(spark, sf_dir, "documents").select(
        "doc_id", T.word_count(F.col("text")).alias("words"), (T.word_count(F.col("text")) >= 50).alias("long_enough"), (F.contains(low, F.lit("the")) & F.contains(low, F.lit("and"))).alias("keywords"), (~F.contains("text", F.lit("$$$"))).alias("clean"), F.regexp_count("text", F.lit(r"\d+")).cast("long").alias("numbers")
    )


@query(
    r"""
SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$', 0) AS name, sha256(regexp_replace(url, '[?#].*$', '')) AS url_sha256 FROM pages
"""
)
def url_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return t(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)).alias("host"), F.regexp_extract(bare, r"[^/]*$", 0).alias("name"), F.sha2(bare.cast("binary"), 256).alias("url_sha256"))


@query(
    """
WITH p AS (SELECT l_orderkey AS id, list({'x': CAST(l_quantity * 3 AS DOUBLE), 'y': CAST(l_discount * 1000 AS DOUBLE)} ORDER BY l_linenumber, l_quantity, l_discount) AS ps FROM lineitem GROUP BY l_orderkey)
SELECT id, '<points coords="' || array_to_string(list_transform(ps, lambda p, i: concat('1 ', i, ' ', CAST(trunc(CASE WHEN p.x <= 100 AND p.y <= 100 THEN p.x * 10 ELSE p.x END) AS INT), ' ', CAST(trunc(CASE WHEN p.x <= 100 AND p.y <= 100 THEN p.y * 10 ELSE p.y END) AS INT))), ';') || '">order</points>' AS text FROM p
"""
)
def points_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", (F.col("l_quantity") * 3).cast("double").alias("x"), (F.col("l_discount") * 1000).cast("double").alias("y")).alias("p"))
    d = d.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("p")).alias("ps"))  # the lines of one order
    return d.select("id", T.points_text(F.col("ps"), F.lit("order")).alias("text"))


@query(
    r"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?|\d+(?:\.\d+)?|[^\w\s]')) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM w GROUP BY token HAVING count(*) >= 2)
SELECT token, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS BIGINT) AS id FROM c ORDER BY n DESC, token LIMIT 5000
"""
)
def vocabulary_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5,000 most frequent tokens (the size of a vocabulary), of equals the smaller, with ids from 2."""
    token = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+(?:'[a-z]+)?|\d+(?:\.\d+)?|[^\w\s]"), F.lit(0)))
    counts = t(spark, sf_dir, "documents").select(token.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    top = counts.orderBy(F.desc("n"), "token").limit(5000)
    return top.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 1).cast("long"))


_PAIR = "conv_id, turn, lower(text) AS a, lower(next_text) AS b"


@query(
    rf"""
WITH p AS (SELECT {_PAIR} FROM {_TURNS} WHERE next_text IS NOT NULL),
w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(a, '\s+'), lambda x: x <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(b, '\s+'), lambda x: x <> '')) AS y FROM p)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(x || y)) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y))::DOUBLE END, 6) AS overlap FROM w
"""
)
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_turn_pairs(spark, sf_dir).select("conv_id", "turn", r6(T.word_overlap(F.col("text"), F.col("next_text"))).alias("overlap"))


@query(
    r"""
WITH p AS (SELECT conv_id, turn, text AS a, next_text AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM """
    + _TURNS
    + r""" WHERE next_text IS NOT NULL),
n AS (SELECT conv_id, turn, k, list_filter(regexp_split_to_array(regexp_replace(lower(a), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS x,
  list_filter(regexp_split_to_array(regexp_replace(lower(b), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS y FROM p),
s AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))), 0) AS same FROM n)
SELECT conv_id, turn, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN CASE WHEN len(x) = len(y) THEN 1 ELSE 0 END WHEN same = 0 THEN 0 ELSE 2.0::DOUBLE * same / (len(x) + len(y)) END::DOUBLE, 6) AS f1 FROM s
"""
)
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.token_f1(next_turn_pairs(spark, sf_dir), ["conv_id", "turn"], F.col("text"), F.col("next_text")).withColumn("f1", r6("f1"))


@query(
    r"""
WITH p AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(lower(next_text), '\s+'), lambda x: x <> '') AS t FROM """
    + _TURNS
    + r""" WHERE next_text IS NOT NULL),
g AS (SELECT conv_id, turn, n, len(p) AS np, len(t) AS nt, list_transform(range(1, greatest(len(p) - n + 2, 1)), lambda i: array_to_string(p[i:i + n - 1], chr(1))) AS x, list_transform(range(1, greatest(len(t) - n + 2, 1)), lambda i: array_to_string(t[i:i + n - 1], chr(1))) AS y FROM p, (SELECT unnest([1, 2, 3, 4]) AS n)),
s AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))), 0) AS same FROM g),
o AS (SELECT conv_id, turn, max(np) AS np, max(nt) AS nt, sum(ln(CASE WHEN same = 0 THEN 0.1 ELSE same END::DOUBLE / greatest(len(x), 1))) AS logs, max(CASE WHEN n = 1 THEN same END) AS words FROM s GROUP BY conv_id, turn)
SELECT conv_id, turn, round(CASE WHEN words = 0 THEN 0 ELSE exp(logs / 4 + CASE WHEN np > nt THEN 0 ELSE 1 - nt / np::DOUBLE END) END::DOUBLE, 6) AS bleu FROM o
"""
)
def bleu4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bleu(next_turn_pairs(spark, sf_dir), ["conv_id", "turn"], F.col("text"), F.col("next_text")).withColumn("bleu", r6("bleu"))


@query(
    rf"""
WITH c AS (SELECT conv_id, turn, role, text, {_WORDS.format("text")} AS n FROM conversations),
r AS (SELECT conv_id, turn, role, text, CASE WHEN n < 10 THEN 0 WHEN n <= 300 THEN 1 WHEN n <= 600 THEN 0.5 ELSE 0 END::DOUBLE AS concise, CASE WHEN contains(lower(text), 'the') THEN 0.5 ELSE 0 END::DOUBLE AS correct FROM c),
s AS (SELECT *, (concise + correct) / 2 AS reward FROM r)
SELECT conv_id, turn, role, round(reward, 6) AS reward, round((reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-8), 4) AS advantage FROM s WINDOW w AS (PARTITION BY conv_id)
"""
)
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    d = t(spark, sf_dir, "conversations").withColumn("reward", (T.concise_reward(c) + F.when(F.contains(F.lower(c), F.lit("the")), 0.5).otherwise(0.0)) / 2)
    return metrics.advantage(d, "conv_id", "reward").select("conv_id", "turn", "role", r6("reward").alias("reward"), F.round("advantage", 4).alias("advantage"))


# ---- evaluation --------------------------------------------------------------------------------------------------

_GUESS = "(SELECT doc_id, quality, CASE WHEN contains(text, '!!') OR contains(text, '$$$') OR contains(text, ' | ') THEN 0 ELSE 1 END AS guess FROM documents JOIN labels USING (doc_id))"


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    junk = F.contains("text", F.lit("!!")) | F.contains("text", F.lit("$$$")) | F.contains("text", F.lit(" | "))
    return t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", F.when(junk, 0).otherwise(1).alias("guess"))


@query(
    f"""
WITH g AS (SELECT * FROM {_GUESS}), l AS (SELECT DISTINCT quality AS label FROM g),
c AS (SELECT label, sum((quality = label)::INT) AS support, sum((guess = label)::INT) AS said, sum((quality = label AND guess = label)::INT) AS hits FROM l CROSS JOIN g GROUP BY label),
p AS (SELECT support, CASE WHEN said > 0 THEN hits / said::DOUBLE ELSE 0 END AS p, hits / support::DOUBLE AS r FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM p)
SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(p * support) / sum(support), 6) AS weighted_precision, round(sum(r * support) / sum(support), 6) AS weighted_recall, round(sum(f * support) / sum(support), 6) AS weighted_f1 FROM f
"""
)
def prf_macro_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.averaged(metrics.per_label(_guesses(spark, sf_dir), "quality", "guess"))


@query(
    """
WITH c AS (SELECT lang, source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY lang, source), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS r, n / sum(n) OVER (PARTITION BY lang)::DOUBLE AS share FROM c)
SELECT lang, source, CAST(n AS BIGINT) AS n, round(share, 6) AS share FROM r WHERE r = 1
"""
)
def most_frequent_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.most_frequent(t(spark, sf_dir, "documents").select("lang", "source", "doc_id"), "lang", "source", "doc_id").withColumn("share", r6("share"))


@query()
def clustered_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _guesses(spark, sf_dir).join(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return metrics.clustered_bootstrap(d.withColumn("right", (F.col("quality") == F.col("guess")).cast("double")), "source", "right")


# ---- audits ------------------------------------------------------------------------------------------------------

_SPLIT = "CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967295::DOUBLE < 0.1 THEN 'val' ELSE 'train' END"


@query(
    f"""
WITH k AS (SELECT {_SPLIT} AS split, 'content' AS kind, sha256(text) AS key FROM documents UNION ALL SELECT {_SPLIT}, 'source', source FROM documents), c AS (SELECT kind, key, split, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY ALL)
SELECT kind, key, string_agg(split, ',' ORDER BY split) AS splits, CAST(sum(n) AS BIGINT) AS rows FROM c GROUP BY kind, key HAVING count(*) > 1
"""
)
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").withColumn("split", F.when(ordering.md5_share(F.col("doc_id")) < 0.1, "val").otherwise("train"))
    return audit.leakage(d, "split", content=F.sha2(F.col("text").cast("binary"), 256), source=F.col("source"))


@query("SELECT doc_id, min(doc_id) OVER w AS first, CAST(count(*) OVER w AS BIGINT) AS copies, doc_id = min(doc_id) OVER w AS kept FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text)")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.first_of_equals(t(spark, sf_dir, "documents").where("text is not null"), F.sha2(F.col("text").cast("binary"), 256), "doc_id")


@query(
    """
SELECT event_type, CAST(user_id AS BIGINT) AS user_id, string_agg(DISTINCT CAST(month(ts) * 100 + day(ts) AS VARCHAR), ',' ORDER BY CAST(month(ts) * 100 + day(ts) AS VARCHAR)) AS sources, CASE WHEN max((value > 99)::INT) = 1 THEN 'ambiguous' ELSE 'resolved' END AS status, min(event_id) AS first FROM events GROUP BY event_type, user_id
"""
)
def dedup_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = (F.month("ts") * 100 + F.dayofmonth("ts")).cast("string")
    d = t(spark, sf_dir, "events").select("event_type", "user_id", day.alias("day"), F.when(F.col("value") > 99, "ambiguous").otherwise("resolved").alias("status"), "event_id")
    return audit.merged(d, ["event_type", "user_id"], "day", "status", "event_id")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(coalesce(sum((trim(CAST({c} AS VARCHAR)) = '')::INT), 0) AS BIGINT) AS blanks, CAST(count(DISTINCT {c}) AS BIGINT) AS \"distinct\", CAST(count({c}) - count(DISTINCT {c}) AS BIGINT) AS duplicates FROM documents"
        for c in ("doc_id", "text", "lang", "source")
    )
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.column_profile(t(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source"])


@query(
    """
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL
"""
)
def full_join_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.matched_both_ways(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), "doc_id")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


# ---- joins -------------------------------------------------------------------------------------------------------


@query(
    """
WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, date_trunc('month', ts)::DATE AS m FROM events), dim AS (SELECT CAST(ts AS DATE) AS day, round(sum(value), 4) AS total FROM events WHERE day(ts) IN (1, 5, 10, 20) GROUP BY 1),
x AS (SELECT e.event_id, a.total AS exact, b.total AS monthly, e.day, (SELECT min(day) FROM dim) AS lo, (SELECT max(day) FROM dim) AS hi FROM e LEFT JOIN dim a ON a.day = e.day LEFT JOIN dim b ON b.day = e.m)
SELECT event_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN monthly IS NOT NULL THEN 'month' WHEN day < lo THEN 'first' WHEN day > hi THEN 'last' ELSE 'error' END AS how, coalesce(exact, monthly, CASE WHEN day < lo THEN (SELECT total FROM dim WHERE dim.day = lo) WHEN day > hi THEN (SELECT total FROM dim WHERE dim.day = hi) END) AS total FROM x
"""
)
def cascade_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's day in a table of days: itself, else its month's first day, else the nearest end of the table."""
    e = t(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), F.trunc("ts", "month").alias("month"), "value")
    dim = e.where(F.dayofmonth("day").isin(1, 5, 10, 20)).groupBy("day").agg(F.round(F.sum("value"), 4).alias("total"))
    ends = dim.agg(F.min(F.struct("day", "total")).alias("lo"), F.max(F.struct("day", "total")).alias("hi"))
    x = e.join(dim.withColumnRenamed("total", "exact"), "day", "left").join(dim.select(F.col("day").alias("month"), F.col("total").alias("monthly")), "month", "left").join(F.broadcast(ends))  # one row
    early, late = F.col("day") < F.col("lo.day"), F.col("day") > F.col("hi.day")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("monthly").isNotNull(), "month").when(early, "first").when(late, "last").otherwise("error")
    return x.select("event_id", how.alias("how"), F.coalesce("exact", "monthly", F.when(early, F.col("lo.total")).when(late, F.col("hi.total"))).alias("total"))


@query(
    """
WITH o AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey)
SELECT coalesce(k, c_custkey) AS k, coalesce(last_order, c_custkey * 0 - 1) AS last_order, coalesce(CASE WHEN c_custkey IS NOT NULL THEN 0 END, n) AS n FROM customer FULL JOIN o ON k = c_custkey
"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("last_order"), F.lit(0).cast("long").alias("n"))
    new = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("last_order"), F.count(F.lit(1)).alias("n"))
    return telemetry.upsert(old, new, ["k"], keep=["n"])


# ---- run logs and fits -------------------------------------------------------------------------------------------


@query(
    """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_pop(value), 4) AS deviation FROM e WHERE n <= 10 OR r > 10 GROUP BY event_type
"""
)
def warmup_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = telemetry.after_warmup(t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], 10)
    f4 = lambda c: F.round(c, 4)
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), f4(F.avg("value")).alias("mean"), f4(F.expr("percentile(value, 0.5)")).alias("median"), f4(F.stddev_pop("value")).alias("deviation"))


@query(
    """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS deviation FROM e WHERE r <= 5 GROUP BY user_id
"""
)
def last_k_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = telemetry.last_k(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5)
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("deviation"))


@query(
    """
WITH u AS (SELECT event_type, user_id, round(sum(value), 4) AS busy FROM events GROUP BY event_type, user_id)
SELECT event_type, min(busy) AS least, arg_min(user_id, (busy, user_id)) AS least_at, max(busy) AS most, arg_max(user_id, (busy, -user_id)) AS most_at, round(avg(busy), 4) AS mean, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN min(busy) > 0 THEN max(busy) / min(busy) END, 4) AS ratio, coalesce(CASE WHEN min(busy) > 0 THEN max(busy) / min(busy) END > 1.5, false) AS straggles FROM u GROUP BY event_type
"""
)
def straggler_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = t(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 4).alias("busy"))
    return telemetry.stragglers(u, ["event_type"], "user_id", "busy").withColumns({"mean": F.round("mean", 4), "ratio": F.round("ratio", 4)})


@query(
    """
SELECT event_id, user_id, CAST(row_number() OVER w AS BIGINT) AS steps, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
"""
)
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = running_in_group(t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "user_id", "value", "ts", "event_id")
    return d.select("event_id", "user_id", "steps", F.round("total", 4).alias("total"))


@query(
    """
WITH p AS (SELECT l_suppkey % 5 AS g, l_quantity::DOUBLE AS x, avg(l_extendedprice)::DOUBLE AS y FROM lineitem GROUP BY 1, 2)
SELECT CAST(g AS BIGINT) AS g, round(regr_slope(log10(y), log10(x)), 5) AS exponent, round(regr_intercept(log10(y), log10(x)), 5) AS log_factor, CAST(count(*) AS BIGINT) AS n FROM p WHERE x > 0 AND y > 0 GROUP BY g
"""
)
def power_law_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).cast("long").alias("g"), F.col("l_quantity").cast("double").alias("x")).agg(F.avg("l_extendedprice").cast("double").alias("y"))
    return telemetry.power_law(p, ["g"], "x", "y").withColumns({"exponent": F.round("exponent", 5), "log_factor": F.round("log_factor", 5)})


@query(
    """
WITH p AS (SELECT l_suppkey % 5 AS g, l_quantity::DOUBLE AS x, ln(avg(l_extendedprice)::DOUBLE) + (l_quantity::DOUBLE - 20) * (l_quantity::DOUBLE - 20) AS y FROM lineitem GROUP BY l_suppkey % 5, l_quantity),
m AS (SELECT g, avg(x) AS m, min(x) AS lo, max(x) AS hi, min(y) AS y_lo, max(y) AS y_hi, count(DISTINCT x) AS points FROM p GROUP BY g), d AS (SELECT g, x - m AS x, (x - m) * (x - m) AS q, y FROM p JOIN m USING (g)),
z AS (SELECT g, avg(q) AS mq, avg(x) AS mx, avg(y) AS my FROM d GROUP BY g), s AS (SELECT g, sum((x - mx) * (x - mx)) AS xx, sum((q - mq) * (q - mq)) AS qq, sum((x - mx) * (q - mq)) AS xq, sum((x - mx) * (y - my)) AS xy, sum((q - mq) * (y - my)) AS qy, any_value(mq) AS mq, any_value(mx) AS mx, any_value(my) AS my FROM d JOIN z USING (g) GROUP BY g),
f AS (SELECT g, (qy * xx - xy * xq) / (qq * xx - xq * xq) AS a, (xy * qq - qy * xq) / (qq * xx - xq * xq) AS b0, mq, mx, my FROM s), h AS (SELECT *, my - a * mq - b0 * mx AS c0 FROM f),
v AS (SELECT *, CASE WHEN a > 1e-12 THEN m - b0 / (2 * a) END AS vertex, CASE WHEN a > 1e-12 THEN c0 - b0 * b0 / (4 * a) END AS value FROM h JOIN m USING (g))
SELECT CAST(g AS BIGINT) AS g, CAST(points AS BIGINT) AS points, round(a, 5) AS a, round(b0 - 2 * a * m, 5) AS b, round(c0 - b0 * m + a * m * m, 5) AS c, round(vertex, 5) AS vertex, round(value, 5) AS value,
  coalesce(a > 1e-12 AND vertex BETWEEN lo AND hi AND value BETWEEN y_lo - 0.5 * (y_hi - y_lo) AND y_hi + 0.5 * (y_hi - y_lo), false) AS trusted FROM v WHERE points >= 3
"""
)
def quadratic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).cast("long").alias("g"), F.col("l_quantity").cast("double").alias("x")).agg(F.avg("l_extendedprice").cast("double").alias("y"))
    p = p.withColumn("y", F.pow(F.col("x") - 20, F.lit(2.0)) + F.log("y"))
    return telemetry.parabola(p, ["g"], "x", "y").withColumns({c: F.round(c, 5) for c in ("a", "b", "c", "vertex", "value")})


# ---- arrays ------------------------------------------------------------------------------------------------------


@query(
    """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (SELECT vec_id, v, list_avg(v) AS mean, list_stddev_samp(v) AS sd FROM e)
SELECT vec_id, round(mean, 5) AS mean, round(sd, 5) AS deviation, round(list_max(list_transform(v, lambda x: (x - mean) / greatest(CASE WHEN sd <= 0 THEN 1 ELSE sd END, 1e-6))), 4) AS top, CAST(len(list_resize(v, 100, 0)) AS BIGINT) AS padded, CAST(len(v[1:48]) AS BIGINT) AS cut FROM m
"""
)
def zscore_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    d = t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    add = lambda f: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + f(x))
    d = d.withColumn("mean", add(lambda x: x) / F.size(v))
    d = d.withColumn("sd", F.sqrt(F.aggregate(F.transform(v, lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda acc, x: acc + x) / (F.size(v) - 1)))
    scale = F.greatest(F.when(F.col("sd") <= 0, 1.0).otherwise(F.col("sd")), F.lit(1e-6))
    padded = F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(100) - F.size(v), F.lit(0))))
    return d.select("vec_id", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("deviation"), F.round((F.array_max(v) - F.col("mean")) / scale, 4).alias("top"), F.size(padded).cast("long").alias("padded"), F.size(F.slice(v, 1, 48)).cast("long").alias("cut"))


@query(
    """
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS deviation, round(sqrt(avg(x * x)), 5) AS rms, round(max(abs(x)), 5) AS largest FROM x GROUP BY label
"""
)
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "embeddings").select("label", F.explode(F.transform("embedding", lambda x: x.cast("double"))).alias("x"))
    f5 = lambda c: F.round(c, 5)
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), f5(F.avg("x")).alias("mean"), f5(F.stddev_pop("x")).alias("deviation"), f5(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("rms"), f5(F.max(F.abs("x"))).alias("largest"))


@query(
    """
WITH d AS (SELECT doc_id, text AS s, length(text) AS n, CAST(doc_id % 50 + 20 AS BIGINT) AS pos FROM documents)
SELECT doc_id, CASE WHEN pos - 10 < 0 OR pos + 3 + 10 > n THEN 'out_of_range' ELSE 'ok' END AS status, CASE WHEN NOT (pos - 10 < 0 OR pos + 3 + 10 > n) THEN substr(s, pos - 9, 23) END AS reference, CASE WHEN NOT (pos - 10 < 0 OR pos + 3 + 10 > n) THEN substr(s, pos - 9, 10) || 'NNNN' || substr(s, pos + 4, 10) END AS variant FROM d
"""
)
def sequence_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 10 about the 3 letters from a place on (counted from 0), and the same with 4 others put in."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("s"), F.length("text").alias("n"), (F.col("doc_id") % 50 + 20).alias("pos"))
    inside = (F.col("pos") - 10 >= 0) & (F.col("pos") + 13 <= F.col("n"))
    part = lambda a, n: F.substr("s", (F.col("pos") + a).cast("int"), F.lit(n))
    return d.select("doc_id", F.when(inside, "ok").otherwise("out_of_range").alias("status"), F.when(inside, part(-9, 23)).alias("reference"), F.when(inside, F.concat(part(-9, 10), F.lit("NNNN"), part(4, 10))).alias("variant"))


# ---- curation and rules ------------------------------------------------------------------------------------------

_RECORD = """concat('ENTRY       N', o_orderkey, chr(10), 'NAME        ', o_orderpriority, chr(10), 'VARIANT     ', o_orderkey, 'v1 (first) ', o_custkey, 'v2', chr(10), '            ', o_orderkey, 'v1 again ', o_orderkey, 'v3', chr(10), chr(10), 'GENE        7157 TP53')"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderkey", F.expr(_RECORD).alias("record"))


_FIELDS = rf"""
r AS (SELECT o_orderkey, {_RECORD} AS record FROM orders),
l AS (SELECT o_orderkey, CAST(i - 1 AS INT) AS line, raw FROM (SELECT o_orderkey, unnest(string_split(record, chr(10))) AS raw, generate_subscripts(string_split(record, chr(10)), 1) AS i FROM r) WHERE trim(raw) <> ''),
n AS (SELECT *, nullif(regexp_extract(raw, '^(\S+)', 1), '') AS named FROM l),
f AS (SELECT o_orderkey, line, last_value(named IGNORE NULLS) OVER (PARTITION BY o_orderkey ORDER BY line) AS field, trim(CASE WHEN named IS NOT NULL THEN regexp_replace(raw, '^\S+', '') ELSE raw END) AS value FROM n)
"""


@query(f"WITH {_FIELDS} SELECT * FROM f")
def flatfile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.record_fields(_records(spark, sf_dir), "o_orderkey", "record")


@query(
    rf"""
WITH {_FIELDS}, x AS (SELECT o_orderkey, line, regexp_extract_all(value, '\d+v\d+') AS ts FROM f WHERE field = 'VARIANT'), u AS (SELECT o_orderkey, line, unnest(ts) AS token, generate_subscripts(ts, 1) AS nth FROM x),
m AS (SELECT o_orderkey, token, min(line * 1000 + nth) AS first FROM u GROUP BY ALL)
SELECT o_orderkey, token, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY first) - 1 AS BIGINT) AS place FROM m
"""
)
def variant_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = curation.record_fields(_records(spark, sf_dir), "o_orderkey", "record")
    return curation.variant_tokens(fields.where("field = 'VARIANT'"), "o_orderkey", records=t(spark, sf_dir, "orders").count())


_SPDI = "concat('NC_', l_suppkey, ':', CASE WHEN l_linenumber = 3 THEN 'x' ELSE CAST(l_partkey AS VARCHAR(20)) END, ':A:', CASE WHEN l_linenumber = 5 THEN 'G:T' ELSE 'G' END)"


@query(
    f"""
WITH s AS (SELECT l_orderkey, l_linenumber, string_split({_SPDI}, ':') AS p FROM lineitem), v AS (SELECT *, len(p) = 4 AND try_cast(p[2] AS BIGINT) IS NOT NULL AS ok FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN p[1] END AS seq, CASE WHEN ok THEN try_cast(p[2] AS BIGINT) END AS pos, CASE WHEN ok THEN p[3] END AS ref, CASE WHEN ok THEN p[4] END AS alt FROM v
"""
)
def spdi_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", curation.coordinates(F.expr(_SPDI)).alias("c"))
    return d.select("l_orderkey", "l_linenumber", "c.seq", "c.pos", "c.ref", "c.alt")


@query(
    """
WITH d AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS same FROM documents), r AS (
  SELECT doc_id, unnest([CASE WHEN NOT coalesce(same = 1, false) THEN 'id repeats' END, CASE WHEN NOT coalesce(trim(text) <> '', false) THEN 'text is blank' END, CASE WHEN NOT coalesce(n_chars = length(text), false) THEN 'length differs' END,
    CASE WHEN NOT coalesce(lang IN ('en', 'de', 'fr'), false) THEN 'language is unknown' END, CASE WHEN NOT coalesce(regexp_matches(source, '^src[0-9]+$'), false) THEN 'source is malformed' END]) AS rule FROM d)
SELECT doc_id, rule FROM r WHERE rule IS NOT NULL
"""
)
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    repeats = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("same"))
    rules = {
        "id repeats": F.col("same") == 1,
        "text is blank": F.trim("text") != "",
        "length differs": F.col("n_chars") == F.length("text"),
        "language is unknown": F.col("lang").isin("en", "de", "fr"),
        "source is malformed": F.col("source").rlike(r"^src[0-9]+$"),
    }
    return curation.violations(d.join(repeats, "doc_id"), "doc_id", rules)


@query(
    """
SELECT lang, CAST(count(*) AS BIGINT) AS n, round(avg(length(text)), 4) AS mean, round(stddev_samp(length(text)), 4) AS deviation, CAST(min(length(text)) AS BIGINT) AS least, CAST(max(length(text)) AS BIGINT) AS most, round(avg((length(text) > 2000)::INT), 6) AS share_long FROM documents GROUP BY lang
"""
)
def describe_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return t(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 4).alias("mean"), F.round(F.stddev_samp(n), 4).alias("deviation"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), r6(F.avg((n > 2000).cast("int"))).alias("share_long"))


@query(
    """
WITH w AS (SELECT event_id // 50 AS w, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1)
SELECT CAST(w AS BIGINT) AS "window", CAST(n AS BIGINT) AS n, round(mean, 4) AS mean FROM w
"""
)
def step_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over runs of 50 steps."""
    w = F.floor(F.col("event_id") / 50).cast("long")
    return t(spark, sf_dir, "events").groupBy(w.alias("window")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))
