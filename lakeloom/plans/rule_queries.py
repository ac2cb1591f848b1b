"""Queries for filters, rules, joins of media and tables, and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import ordering, pairing, rules
from lakeloom.plans.queries import query, r6, t


@query(
    """
SELECT l_orderkey, l_linenumber, l_linenumber % 3 <> 0 AND l_linenumber % 2 = 0 AS sample, l_returnflag IN ('R', 'A') AND l_linestatus = 'F' AS located, l_linenumber <> 5 AND l_quantity > 25 AS complete FROM lineitem
"""
)
def sample_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    extensions = F.array(F.when(k % 3 != 0, "png").otherwise("json"), F.when(k % 2 == 0, "txt").otherwise("cls"))
    place = F.when(F.col("l_linestatus") == "F", F.col("l_linestatus")).otherwise(" ")
    return t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", rules.has_image_and_text(extensions).alias("sample"), rules.located(F.col("l_returnflag"), place, ("R", "A")).alias("located"), rules.complete(F.when(k != 5, "x"), F.when(F.col("l_quantity") > 25, F.col("l_quantity"))).alias("complete")
    )


@query(
    r"""
WITH d AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT lang, CAST(count(*) AS BIGINT) AS rows, CAST(sum((n BETWEEN 5 AND 120 AND octet_length(encode(source)) <= 4 AND lang <> '')::INT) AS BIGINT) AS kept, round(avg((n BETWEEN 5 AND 120 AND octet_length(encode(source)) <= 4 AND lang <> '')::INT), 6) AS share FROM d GROUP BY lang
"""
)
def caption_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rules.in_budget(F.col("text"), 5, 120, F.col("source"), 4, F.col("lang"))
    return rules.retention(t(spark, sf_dir, "documents"), kept, "lang").withColumn("share", r6("share"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id::VARCHAR = '8'")
def equal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.where(rules.equal_fields(e, {"event_type": "click", "user_id": "8", "absent": "None"})).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE event_id % 5 IN (1, 4) AND value > 0 AND event_type <> 'error'")
def usable_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as text, some of them not numbers, infinite, negative or missing."""
    k = F.col("event_id") % 5
    v = F.when(k == 0, "NaN").when(k == 2, "-Infinity").when(k == 3, F.concat(F.lit("-"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    return t(spark, sf_dir, "events").where(rules.usable_number(F.when(F.col("event_type") != "error", v))).select("event_id")


@query(
    """
WITH c AS (SELECT DISTINCT p_brand, 'm' || p_brand || CASE p_size % 4 WHEN 0 THEN '-1.7B' WHEN 1 THEN '-8B' WHEN 2 THEN '-32B' ELSE '' END AS backbone, power(10::DOUBLE, 17 + p_size % 5) AS budget FROM part)
SELECT DISTINCT backbone, log10(budget) AS exponent FROM c WHERE CASE WHEN backbone LIKE '%-8B' THEN budget >= 1e19 WHEN backbone LIKE '%-32B' THEN budget >= (SELECT min(b) FROM (SELECT DISTINCT budget AS b FROM c ORDER BY b DESC LIMIT 2)) ELSE true END
"""
)
def eligible_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    backbone = F.concat(F.lit("m"), F.col("p_brand"), F.when(k == 0, "-1.7B").when(k == 1, "-8B").when(k == 2, "-32B").otherwise(""))
    cells = t(spark, sf_dir, "part").select(backbone.alias("backbone"), F.pow(F.lit(10.0), 17 + F.col("p_size") % 5).alias("budget")).distinct()
    return rules.eligible_budgets(cells, "backbone", "budget").select("backbone", F.log10("budget").alias("exponent"))


@query(
    """
WITH c AS (SELECT l_orderkey, count(*) AS n, min(l_linestatus) AS s, max(l_partkey) AS p FROM lineitem GROUP BY l_orderkey), r AS (SELECT CASE WHEN l_orderkey // 500 > 20 THEN 'chunk' WHEN s <> 'F' THEN 'file' WHEN n < 2 THEN 'length' WHEN p % 7 = 0 THEN 'instruction' ELSE 'kept' END AS reason FROM c)
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY reason
"""
)
def usable_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_linestatus").alias("s"), F.max("l_partkey").alias("p"))
    got = rules.usable_episodes(d, "l_orderkey", "n", F.col("s") == "F", F.when(F.col("p") % 7 != 0, "do it"), chunk=500)
    return got.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
WITH p AS (SELECT DISTINCT p_brand, p_type FROM part), x AS (SELECT p_brand, list(DISTINCT p_type) AS needs FROM p GROUP BY p_brand), d AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN (SELECT list(DISTINCT p_type) FROM part) ELSE ['ECONOMY'] END AS offers, ['ECONOMY'] AS requires FROM nation)
SELECT p_brand, n_nationkey FROM x, d WHERE len(list_filter(needs, lambda n: NOT list_contains(offers, n))) = 0 AND len(list_filter(requires, lambda n: NOT list_contains(needs, n))) = 0
"""
)
def compatible_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    presets = p.groupBy("p_brand").agg(F.collect_set("p_type").alias("needs"))  # a few kinds
    every = p.agg(F.collect_set("p_type").alias("all"))
    designs = t(spark, sf_dir, "nation").join(every).select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("all")).otherwise(F.array(F.lit("ECONOMY"))).alias("offers"), F.array(F.lit("ECONOMY")).alias("requires"))
    return rules.compatible(presets, designs, "needs", "offers", "requires").select("p_brand", "n_nationkey")


_LOCATED = "(SELECT o_orderkey, o_orderkey * 512 AS header, o_orderkey * 512 + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 512 END AS data, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey END AS size, o_orderkey || CASE WHEN o_orderkey % 11 = 0 THEN '.png' ELSE '.jpg' END AS member FROM orders)"


@query(
    f"""
SELECT o_orderkey, unnest(list_filter([CASE WHEN header % 512 <> 0 THEN 'header' END, CASE WHEN data <> header + 512 THEN 'data' END, CASE WHEN size <= 0 THEN 'size' END, CASE WHEN data + size > 5000000 THEN 'bounds' END, CASE WHEN member <> o_orderkey || '.jpg' THEN 'member' END], lambda x: x IS NOT NULL)) AS rule FROM {_LOCATED}
"""
)
def locator_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    d = t(spark, sf_dir, "orders").select("o_orderkey", o.cast("string").alias("key"), (o * 512).alias("header"), (o * 512 + F.when(o % 5 == 0, 0).otherwise(512)).alias("data"), F.when(o % 7 == 0, 0).otherwise(F.col("o_custkey")).alias("size"), F.concat(o.cast("string"), F.when(o % 11 == 0, ".png").otherwise(".jpg")).alias("member"), F.lit(5_000_000).alias("bytes"))
    return rules.violations(d, "o_orderkey", rules.locator_rules("header", "data", "size", "member", "key", "bytes"))


@query(
    """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN lang || '-' || doc_id ELSE lang || '_' || doc_id END AS key, CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END AS split, text FROM documents)
SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'id' END, CASE WHEN doc_id % 9 = 0 OR doc_id % 4 = 0 THEN 'split' END, CASE WHEN doc_id % 6 = 0 THEN 'file' END, CASE WHEN doc_id % 10 = 0 THEN 'description' END], lambda x: x IS NOT NULL)) AS rule FROM d
"""
)
def description_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    key = F.concat("lang", F.when(i % 9 == 0, "-").otherwise("_"), i.cast("string"))
    d = t(spark, sf_dir, "documents").select("doc_id", key.alias("key"), F.when(i % 4 == 0, "xx").otherwise(F.col("lang")).alias("split"), F.concat(key, F.when(i % 6 == 0, ".png").otherwise(".jpg")).alias("file"), F.when(i % 10 == 0, " ").otherwise("said").alias("text"))
    return rules.violations(d, "doc_id", rules.description_rules("key", "file", "split", "text"))


@query(
    """
SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 13 = 0 THEN 'id' END, CASE WHEN o_orderkey % 4 = 3 THEN 'task' END, CASE WHEN o_orderkey % 5 = 0 THEN 'prompt' END, CASE WHEN o_orderkey % 4 = 3 OR o_orderkey % 4 <> o_orderkey % 3 AND o_orderkey % 4 = 0 OR o_orderkey % 4 = 1 AND o_orderkey % 3 < 1 OR o_orderkey % 4 = 2 AND o_orderkey % 3 < 2 THEN 'sources' END,
  CASE WHEN o_custkey % 3 = 0 THEN 'seeds' END, CASE WHEN o_orderkey % 17 = 0 THEN 'size' END], lambda x: x IS NOT NULL)) AS rule FROM orders
"""
)
def case_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    task = F.element_at(F.array(F.lit("t2i"), F.lit("edit"), F.lit("in_context"), F.lit("else")), (o % 4 + 1).cast("int"))
    seeds = F.array(c % 3, F.lit(0).cast("long"), F.lit(5).cast("long"))
    d = t(spark, sf_dir, "orders").select("o_orderkey", F.when(o % 13 == 0, "a/b").otherwise(o.cast("string")).alias("key"), task.alias("task"), F.when(o % 5 != 0, F.col("o_orderpriority")).alias("prompt"), F.array_repeat(F.lit("s"), (o % 3).cast("int")).alias("sources"), seeds.alias("seeds"), F.lit("g").alias("group"), F.lit("val").alias("split"), F.when(o % 17 == 0, 500).otherwise(512).alias("width"), F.lit(512).alias("height"))
    return rules.violations(d, "o_orderkey", rules.case_rules("key", "task", "prompt", "sources", "seeds", "group", "split", "width", "height"))


@query(
    """
SELECT 'group' AS kind, o_custkey::VARCHAR AS key, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS splits FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1
"""
)
def split_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.split_owners(t(spark, sf_dir, "orders"), "group", F.col("o_custkey"), "o_orderstatus")


@query(
    r"""
WITH d AS (SELECT source, doc_id % 6 = 0 AS missing, doc_id % 6 <> 0 AND doc_id % 5 = 0 AS blank, doc_id % 7 = 0 AS bare, doc_id % 3 = 0 AS unposed, doc_id % 4 = 0 AS broken FROM documents),
c AS (SELECT source, count(*) AS samples, sum((NOT (missing OR blank OR bare OR unposed OR broken))::INT) AS valid, sum(missing::INT) AS a, sum(blank::INT) AS b, sum(bare::INT) AS c, sum(unposed::INT) AS d, sum((broken AND NOT unposed)::INT) AS e FROM d GROUP BY source)
SELECT source, CAST(samples AS BIGINT) AS samples, CAST(valid AS BIGINT) AS valid, array_to_string(list_filter([CASE WHEN b > 0 THEN 'empty_text=' || b END, CASE WHEN e > 0 THEN 'failed_pose.npy=' || e END, CASE WHEN c > 0 THEN 'missing_image=' || c END, CASE WHEN d > 0 THEN 'missing_pose.npy=' || d END, CASE WHEN a > 0 THEN 'missing_text=' || a END], lambda x: x IS NOT NULL), ',') AS problems FROM c
"""
)
def shard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples, some without text, image or pose, or with a pose of two dimensions."""
    i = F.col("doc_id")
    npy = lambda shape: F.concat(F.unhex(F.lit("934E554D50590100")), F.lit("v\0").cast("binary"), F.lit(f"{{'descr': '<f4', 'fortran_order': False, 'shape': {shape}, }}".ljust(118)).cast("binary"))
    part = lambda name, value, there: F.when(there, F.struct(F.lit(name).alias("k"), value.alias("v")))
    text = F.when(i % 5 == 0, F.lit(" \n")).otherwise(F.lit("a b")).cast("binary")
    parts = F.array(part("txt", text, i % 6 != 0), part("png", F.lit("x").cast("binary"), i % 7 != 0), part("pose.npy", F.when(i % 4 == 0, npy("(2, 3)")).otherwise(npy("(7,)")), i % 3 != 0))
    d = t(spark, sf_dir, "documents").select("source", F.map_from_entries(F.filter(parts, lambda p: p.isNotNull())).alias("parts"))
    return rules.shard_report(d, "source", "parts", ("text", "image", "pose.npy"))


@query("SELECT page_id, page_id % 4 NOT IN (1, 2, 3) AS safe FROM pages")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("a..b/..c/"), n)).when(k == 1, F.concat(F.lit("/abs/"), n)).when(k == 2, F.concat(F.lit("a/../"), n)).otherwise(F.concat(F.lit("a\\"), n))
    return t(spark, sf_dir, "pages").select("page_id", rules.safe_path(path).alias("safe"))


@query(
    """
WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source <> 'src1' GROUP BY source), e AS (SELECT source, count(*) + CASE WHEN source = 'src2' THEN 1 ELSE 0 END AS expected FROM documents GROUP BY source)
SELECT source, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(expected AS BIGINT) AS expected FROM e LEFT JOIN c USING (source) WHERE coalesce(n, 0) <> expected
"""
)
def unmet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return rules.unmet_counts(d.where("source <> 'src1'"), d.select("source", (F.col("n") + F.when(F.col("source") == "src2", 1).otherwise(0)).alias("expected")), "source")


@query(
    """
WITH p AS (SELECT DISTINCT '/data/' || s_nationkey AS path FROM supplier WHERE s_suppkey % 2 = 0)
SELECT n_name AS name, CASE WHEN n_nationkey % 6 = 0 THEN 'Skipped' WHEN n_nationkey % 4 = 3 THEN CASE WHEN n_nationkey % 5 = 0 THEN 'Error' ELSE 'Ready (Remote)' END WHEN path IS NOT NULL THEN 'Ready (Local)' ELSE 'Missing Local' END AS status FROM nation LEFT JOIN p ON path = '/data/' || n_nationkey
"""
)
def readiness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    catalogue = t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (k % 6 == 0).alias("skip"), F.when(k % 4 != 3, F.concat(F.lit("/data/"), k.cast("string"))).alias("local"), F.when(k % 5 != 0, "hub").alias("remote"))
    there = t(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("/data/"), F.col("s_nationkey").cast("string")).alias("path"))
    return rules.readiness(catalogue, there, "name", "skip", "local", "remote")


@query("SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN length(text) < 40 THEN 'short' WHEN lang NOT IN ('en', 'de') THEN 'lang' WHEN contains(text, '!!') THEN 'junk' ELSE 'kept' END AS reason FROM documents) GROUP BY reason")
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.exclusions(t(spark, sf_dir, "documents"), {"short": F.length("text") >= 40, "lang": F.col("lang").isin("en", "de"), "junk": ~F.contains("text", F.lit("!!"))})


# ---- joins -------------------------------------------------------------------------------------------------------


@query(
    """
WITH m AS (SELECT regexp_extract(url, '[^/]*$') AS name, min(url) AS local_path FROM pages WHERE page_id % 2 = 0 GROUP BY 1)
SELECT event_id, local_path FROM (SELECT event_id, '/old/' || regexp_extract(url, '[^/]*$') AS path FROM events JOIN pages ON page_id = event_id % 200) e JOIN m ON name = regexp_extract(path, '[^/]*$')
"""
)
def media_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "pages").select("page_id", "url")
    e = t(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 200).alias("page_id")).join(p, "page_id").select("event_id", F.concat(F.lit("/old/"), F.regexp_extract("url", r"[^/]*$", 0)).alias("path"))
    return pairing.by_base_name(e, "path", p.where("page_id % 2 = 0"), "url").select("event_id", "local_path")


@query(
    """
SELECT o_orderkey, CAST(month(o_orderdate) AS INT) AS part, count(*)::BIGINT AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND month(l_shipdate) = month(o_orderdate) GROUP BY ALL
"""
)
def joined_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.month("o_orderdate").alias("part"))
    lines = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.month("l_shipdate").alias("part"))
    return pairing.by_shared_partition(o, lines, "part", "o_orderkey").groupBy("o_orderkey", "part").agg(F.count(F.lit(1)).alias("lines"))


@query(
    """
SELECT c_custkey, o_orderkey, o_orderstatus, o_orderstatus IS NOT NULL AS matched FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders) n ON o_custkey = c_custkey LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 > 0) m USING (o_orderkey)
"""
)
def token_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    tokens, networks = t(spark, sf_dir, "customer").select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return pairing.token_context(tokens, networks, o.where("o_orderkey % 3 > 0").select("o_orderkey", "o_orderstatus"), "c_custkey", "o_orderkey").select("c_custkey", "o_orderkey", "o_orderstatus", "matched")


@query("SELECT doc_id, lang, quality, label FROM documents JOIN labels USING (doc_id) JOIN (SELECT vec_id AS doc_id, label FROM embeddings) USING (doc_id)")
def in_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return pairing.in_all("doc_id", t(spark, sf_dir, "documents").select("doc_id", "lang"), t(spark, sf_dir, "labels").select("doc_id", "quality"), e)


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'good' WHEN doc_id % 2 = 0 THEN source END AS task FROM documents LEFT JOIN labels USING (doc_id)")
def with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    first = t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise(" ").alias("task"))
    return pairing.with_fallback(d.select("doc_id"), first, d.where("doc_id % 2 = 0").select("doc_id", F.col("source").alias("task")), "doc_id", "task")


@query(
    """
WITH p AS (SELECT p_brand, p_type, avg(p_retailprice) AS expected FROM part GROUP BY ALL), c AS (SELECT p_brand, p_type, avg(p_retailprice) + max(p_size) * 3 AS measured FROM part WHERE p_brand NOT LIKE '%3' GROUP BY ALL)
SELECT p_brand, p_type, CASE WHEN measured IS NULL THEN 'missing' WHEN abs(measured - expected) > 0.1 * abs(expected) THEN 'mismatch' ELSE 'matched' END AS status FROM p LEFT JOIN c USING (p_brand, p_type)
"""
)
def calibrated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    cells = p.groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("expected"))
    got = p.where("p_brand not like '%3'").groupBy("p_brand", "p_type").agg((F.avg("p_retailprice") + F.max("p_size") * 3).alias("measured"))
    return pairing.calibrated(cells, got, ["p_brand", "p_type"], "expected", "measured", 0.1).select("p_brand", "p_type", "status")


@query("SELECT o_custkey AS run_id, 'a' AS plan FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT c_custkey, 'b' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def first_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("run_id")).distinct().withColumn("plan", F.lit("a"))
    return pairing.first_plans(a, t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("b").alias("plan")), key="run_id")


@query("SELECT p_partkey FROM part WHERE p_size % 3 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 40 = 0)")
def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = t(spark, sf_dir, "lineitem").where("l_orderkey % 40 = 0").select(F.col("l_partkey").alias("p_partkey"))
    return pairing.uncovered(t(spark, sf_dir, "part").withColumn("skip", F.col("p_size") % 3 == 0), loaded, "p_partkey", "skip")


# ---- batches -----------------------------------------------------------------------------------------------------


@query(
    """
WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey)[1:5] AS v FROM lineitem GROUP BY l_orderkey), b AS (SELECT l_orderkey // 8 AS batch, max(len(v)) AS width, sum(len(v)) AS n, count(*) AS rows, sum(list_sum(v)) AS total FROM o GROUP BY 1)
SELECT CAST(batch AS BIGINT) AS batch, CAST(width AS INT) AS width, CAST(n AS BIGINT) AS kept, CAST(rows * width - n AS BIGINT) AS filled, CAST(total - (rows * width - n) AS BIGINT) AS total FROM b
"""
)
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' part numbers in batches of eight order keys, filled with -1."""
    d = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("ls"))  # the lines of one order
    b = pairing.padded_batches(d.select("l_orderkey", F.col("ls.l_partkey").alias("v")), "l_orderkey", "v", 8, 5, -1)
    add = lambda c: F.aggregate(F.flatten(c), F.lit(0).cast("long"), lambda a, x: a + x)
    return b.select("batch", "width", add("mask").alias("kept"), (F.size(F.flatten("mask")) - add("mask")).cast("long").alias("filled"), add("ids").alias("total"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS r FROM orders) WHERE r > 700")
def skipped_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.skipped(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), 700, "o_custkey", "o_orderkey").select("o_orderkey")


_SHARE = "('0x' || substr(sha256('{1}:' || {0}), 1, 8))::BIGINT / 4294967296::DOUBLE"


@query(f"SELECT o_orderkey, CAST(o_orderkey // 256 * 256 + row_number() OVER (PARTITION BY o_orderkey // 256 ORDER BY {_SHARE.format('o_orderkey', 3)}, o_orderkey) - 1 AS BIGINT) AS place FROM orders")
def shuffle_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.shuffled_blocks(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 256, 3)


@query(
    f"""
WITH s AS (SELECT DISTINCT p_brand AS dataset, p_partkey AS name FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {_SHARE.format("dataset || ':' || name", 5)}, name) - 1 AS k FROM s), n AS (SELECT *, CAST(k % 4 AS INT) AS node FROM k WHERE k // 4 < 10),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {_SHARE.format("node || ':' || dataset || ':' || name", 6)}, dataset, name) - 1 AS place FROM n)
SELECT dataset, name, node, CAST(place AS BIGINT) AS place FROM r WHERE place < 200
"""
)
def assigned_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("name"))
    return pairing.assigned_shards(s, "dataset", "name", 4, 5, per_dataset=10, per_node=200)


@query("SELECT l_orderkey, l_linenumber, CAST(100 + row_number() OVER (ORDER BY year(l_shipdate), l_orderkey, l_linenumber, l_partkey) - 1 AS BIGINT) AS idx FROM lineitem")
def continued_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.year("l_shipdate").alias("part"))
    return pairing.continued_index(d, "part", "l_orderkey", "l_linenumber", "l_partkey", start=100).select("l_orderkey", "l_linenumber", "idx")


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_SHARE.format('doc_id', 9)}, doc_id) > count(*) OVER () - floor(count(*) OVER () * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM documents")
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id")
    return pairing.exact_split(d, ordering.sha_share(F.col("doc_id"), 9), "doc_id", 0.15)
