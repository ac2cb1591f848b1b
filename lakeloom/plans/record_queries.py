"""Queries for the column functions over raw records; the records are made from rows of the tables, all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import records as R
from lakeloom.plans.queries import query, t


@query(
    """
WITH l AS (SELECT l_orderkey, list({'k': l_linenumber, 'p': l_partkey, 's': l_suppkey} ORDER BY l_linenumber, l_partkey, l_suppkey) AS ps FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_concat(['order'], list_transform(list_filter(ps, lambda p: p.k <> 2), lambda p: concat('(', p.p, ',', p.s, ')'))), ' ') AS text FROM l
"""
)
def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as points; second lines have no y."""
    y = F.when(F.col("l_linenumber") != 2, F.col("l_suppkey"))
    point = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").alias("x"), y.alias("y"))
    d = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("ps"))  # the lines of one order
    return d.select("l_orderkey", R.labelled_points(F.lit("order"), F.col("ps")).alias("text"))


@query(
    """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'No caption' WHEN 1 THEN 'An image.' WHEN 2 THEN source ELSE lang END AS text, '[pixmo_cap] ' || CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE doc_id::VARCHAR END AS meta FROM documents
"""
)
def dense_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    first, other = F.when(k == 1, F.lit("  ")).when(k == 2, F.col("source")), F.when(k == 3, F.col("lang"))
    d = t(spark, sf_dir, "documents").select("doc_id", R.dense_caption(first, other, "pixmo_cap", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id"))).alias("r"))
    return d.select("doc_id", "r.text", "r.meta")


@query(
    r"""
WITH c AS (SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN text END, ' ' ORDER BY turn, role, text), '') AS u, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ' ' ORDER BY turn, role, text), '') AS a, 'image-' || min(turn) AS image FROM conversations GROUP BY conv_id),
d AS (SELECT conv_id, regexp_replace(u, '^\s+|\s+$', '', 'g') AS u, regexp_replace(a, '^\s+|\s+$', '', 'g') AS a, image FROM c)
SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN a WHEN 1 THEN 'Question: ' || u || chr(10) || 'Answer: ' || a ELSE 'User: ' || u || chr(10) || 'Assistant: ' || a END AS text, image FROM d
"""
)
def typed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's content as a text part and an image part; three styles in turn."""
    none = F.lit(None).cast("string")
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), none.alias("image")), F.struct(F.lit("image").alias("type"), none.alias("text"), F.concat(F.lit("image-"), F.col("turn").cast("string")).alias("image")))
    message = F.struct("turn", "role", "text", parts.alias("content"))
    d = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("ms"))  # the turns of one conversation
    d = d.select("conv_id", R.typed_turns(F.col("ms")).alias("r"))
    style = F.element_at(F.array(F.lit("caption"), F.lit("qa"), F.lit("conversation")), (F.col("conv_id") % 3 + 1).cast("int"))
    return d.select("conv_id", R.training_text(F.col("r.user"), F.col("r.assistant"), style).alias("text"), "r.image")


@query(
    """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'This timeseries has ' || CASE WHEN user_id % 2 = 0 THEN 'a rise over time' ELSE 'it exhibits a flat' END || '.' ELSE 'This timeseries exhibits the following characteristic: ' || CASE WHEN user_id % 2 = 0 THEN 'Up' ELSE 'flat' END || '.' END AS text FROM events
"""
)
def defined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("user_id") % 2 == 0, " Up ").otherwise("flat")
    got = R.defined_label(F.col("event_type"), label, {"click": {"up": "a rise over time"}, "view": {"up": "a rise over time"}}, {"click": "it exhibits a {}", "view": "it exhibits a {}"})
    return t(spark, sf_dir, "events").select("event_id", got.alias("text"))


@query(
    """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE)[1:vec_id % 9 + 1] AS v FROM embeddings)
SELECT vec_id, CAST(6 AS BIGINT) AS n, CAST(least(len(v), 6) AS BIGINT) AS kept, round(list_sum(v[1:6]), 6) AS total FROM e
"""
)
def fixed_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.slice(F.col("embedding").cast("array<double>"), F.lit(1), (F.col("vec_id") % 9 + 1).cast("int"))
    d = t(spark, sf_dir, "embeddings").select("vec_id", R.fixed_length(v, 6).alias("a"), R.fixed_length(v, 6, dynamic=True).alias("b"))
    return d.select("vec_id", F.size("a").cast("long").alias("n"), F.size("b").cast("long").alias("kept"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(
    """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN 'Describe this time series.' WHEN 2 THEN 'what ' || o_custkey || '?' ELSE o_orderpriority END AS prompt,
  CASE o_orderkey % 4 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN 'Description: ' || o_orderpriority || chr(10) || 'Characteristics: ' || o_orderstatus WHEN 2 THEN 'it Answer: is' ELSE '' END AS target FROM orders
"""
)
def question_and_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 2, F.concat(F.lit("Question: what "), F.col("o_custkey").cast("string"), F.lit("?\nAnswer: it Answer: is"))).when(k == 3, F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")))
    got = R.question_and_target([F.when(k == 0, F.col("o_orderstatus"))], [F.when(k == 0, F.col("o_custkey").cast("string"))], F.when(k == 1, F.col("o_orderpriority")), F.col("o_orderstatus"), text)
    return t(spark, sf_dir, "orders").select("o_orderkey", got.alias("r")).select("o_orderkey", "r.prompt", "r.target")


@query(
    """
WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, [o_custkey::DOUBLE, o_totalprice, -1.5] AS v FROM orders)
SELECT o_orderkey, CAST(CASE k WHEN 3 THEN 12 WHEN 4 THEN 0 ELSE 3 END AS BIGINT) AS n, CASE k WHEN 3 THEN round(4 * (v[1] + v[2] - 1.5), 4) WHEN 4 THEN NULL ELSE round(v[1] + v[2] - 1.5, 4) END AS total FROM o
"""
)
def series_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' numbers as a bracketed text under the first or the second key, a long list, or a marked text, or as words."""
    k, v = F.col("o_orderkey") % 5, F.array(F.col("o_custkey").cast("double"), F.col("o_totalprice"), F.lit(-1.5))
    said = F.array_join(v.cast("array<string>"), ", ")
    bracketed = F.concat(F.lit("["), said, F.lit("]"))
    lists = [v, F.when(k == 3, F.flatten(F.array_repeat(v, 4)))]
    text = F.when(k == 2, F.concat(F.lit("###"), F.replace(said, F.lit(", "), F.lit("###")), F.lit("###"))).when(k == 4, F.lit("### words ###"))
    values = R.series_values([F.when(k == 0, bracketed), F.when(k == 1, bracketed).when(k == 3, F.lit("none"))], lists, text)
    total = F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4)
    return t(spark, sf_dir, "orders").select("o_orderkey", values.alias("v")).select("o_orderkey", F.coalesce(F.size("v"), F.lit(0)).cast("long").alias("n"), total.alias("total"))


@query("SELECT vec_id, CAST(CASE WHEN vec_id % 2 = 0 THEN 3 ELSE 1 END AS BIGINT) AS n FROM embeddings")
def variates_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector ten times over as a multivariate series, under two lengths; one of them is longer than the budget."""
    rows = F.array_repeat(F.col("embedding"), 10)
    return t(spark, sf_dir, "embeddings").select("vec_id", F.size(F.when(F.col("vec_id") % 2 == 0, R.variates_kept(rows, 1024, 256)).otherwise(R.variates_kept(rows, 1024, 2000))).cast("long").alias("n"))


@query(
    """
SELECT p_partkey, 'Describe this time series.' || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Characteristics:' || chr(10) || p_type ELSE '' END AS prompt, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_type ELSE p_name END AS target FROM part
"""
)
def instruction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    got = R.instruction_pair(F.col("p_name"), F.when(k == 0, F.col("p_brand")).otherwise(" "), F.when(k == 1, F.col("p_type")), F.when(F.col("p_size") % 2 == 0, F.col("p_type")))
    return t(spark, sf_dir, "part").select("p_partkey", got.alias("r")).select("p_partkey", "r.prompt", "r.target")


@query(
    """
WITH l AS (SELECT l_orderkey, list(printf('%s(%.2f, %.2f, %.2f)', l_returnflag, l_quantity, l_discount, l_tax) ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(a[1:3], '; ') || CASE WHEN len(a) > 3 THEN printf(' and %d more', len(a) - 3) ELSE '' END AS atoms, 'Order lines: ' || len(a) || ', first flag: ' || a[1][1] || '.' AS about FROM l
"""
)
def template_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("element"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    d = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("a"))  # the lines of one order
    return d.select("l_orderkey", R.atoms_text(F.col("a"), 3).alias("atoms"), R.about_text("Order", [("lines", F.size("a")), ("nothing", F.lit(None).cast("string")), ("first flag", F.col("a")[0]["element"])]).alias("about"))


@query(
    r"""
WITH d AS (SELECT doc_id, '<|im_start|>user' || chr(10) || source || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS p, text, lang FROM documents), j AS (SELECT *, p || '<think>' || chr(10) || text || chr(10) || '</think>' || chr(10) || '<answer>' || lang || '</answer><|im_end|>' AS j FROM d)
SELECT doc_id, sha256(j) AS joint, CAST(len(list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '')) AS BIGINT) AS prompt_len, CAST(len(list_filter(regexp_split_to_array(j, '\s+'), lambda x: x <> '')) - len(list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '')) AS BIGINT) AS target_len FROM j
"""
)
def reasoned_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = (F.col("source"), F.col("text"), F.col("lang"), "<|im_end|>")
    d = t(spark, sf_dir, "documents").select("doc_id", R.reasoned_chat(*how, prompt_only=True).alias("p"), R.reasoned_chat(*how).alias("j"))
    return d.select("doc_id", F.sha2(F.col("j").cast("binary"), 256).alias("joint"), R.token_split(F.col("p"), F.col("j")).alias("r")).select("doc_id", "joint", "r.*")


@query("SELECT conv_id, turn, CAST(CASE WHEN turn % 2 = 0 THEN 4 ELSE 0 END AS BIGINT) AS n FROM conversations")
def prompt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Question: how? "), F.lit("\nwell Answer: "), F.col("text"), F.lit(" Answer: no"))).otherwise(F.replace("text", F.lit("Answer:"), F.lit("")))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", R.prompt_words(text).alias("n"))


@query(
    """
SELECT o_orderkey, '{"id":"' || CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey END || '"' || CASE WHEN o_orderkey % 3 = 0 THEN ',"label":"' || o_orderstatus || '"' ELSE '' END || ',"class":"' || o_orderpriority || '"}' AS metadata,
  '[order] ' || CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR ELSE 'unknown' END AS meta FROM orders
"""
)
def projected_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    got = R.projected_metadata([F.when(o % 2 == 0, c), o], {"label": F.when(o % 3 == 0, F.col("o_orderstatus")), "class": F.col("o_orderpriority")})
    return t(spark, sf_dir, "orders").select("o_orderkey", got.alias("metadata"), R.row_label("order", F.when(o % 2 == 0, c), F.when(o % 3 == 0, o)).alias("meta"))


@query(
    """
WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN event_type || ', extra' WHEN 2 THEN 'contain=True, start_time=' || user_id WHEN 3 THEN 'contain=False' ELSE props END AS a FROM events)
SELECT event_id, CASE WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN 'Forecast.' WHEN event_id % 7 = 0 THEN 'Question: q ' || event_id WHEN event_id % 2 = 0 THEN 'Answer: ' || a ELSE 'Question: q ' || event_id || chr(10) || 'Answer: ' || a END AS text FROM e
"""
)
def rendered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("event_id"), F.col("event_id") % 5
    a = R.rendered_result(F.when(k == 0, F.col("event_type")).otherwise(" "), F.when(k == 1, F.array(F.col("event_type"), F.lit(" "), F.lit(" extra"))), F.when(k == 2, True).when(k == 3, False), F.when(k == 2, F.col("user_id")), F.col("props"))
    text = R.question_answer_text(F.when(e % 2 != 0, F.concat(F.lit("q "), e.cast("string"))), F.when(e % 7 != 0, a), "Forecast.")
    return t(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'look' ELSE 'unknown' END AS task, CASE WHEN event_type = 'error' THEN 'Fault' WHEN contains(event_type, 'c') THEN 'Act' ELSE 'Unknown' END AS domain, CASE WHEN event_type = 'view' THEN 'seen' ELSE event_type END AS named FROM events")
def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    return t(spark, sf_dir, "events").select("event_id", R.looked_up(e, {"click": "press", "view": "look"}, "unknown").alias("task"), R.first_matching(F.upper(e), [("error", "Fault"), ("c", "Act")]).alias("domain"), R.looked_up(e, {"view": "seen"}, e).alias("named"))


@query(
    """
SELECT o_orderkey, unnest(['ClinVar', 'ClinVar', 'dbSNP']) AS source, unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, 'rs' || o_custkey]) AS id FROM orders
"""
)
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.concat(F.lit("  clinvar: "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_custkey").cast("string"), F.lit("\nDBSNP:rs"), F.col("o_custkey").cast("string"), F.lit("\nOther: 1\nno line"))
    d = t(spark, sf_dir, "orders").select("o_orderkey", F.explode(R.cross_references(lines, ["ClinVar", "dbSNP"])).alias("r"))
    return d.select("o_orderkey", "r.source", "r.id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS symbol, p_type || '; ' || p_name AS pathway FROM part")
def gene_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    token = F.when(F.col("p_partkey") % 3 == 0, F.concat(k, F.lit("v1"))).when(F.col("p_partkey") % 3 == 1, F.concat(k, F.lit("0v2"))).otherwise("none")
    genes = F.concat(F.lit("  1"), k, F.lit("  OTHER; x\n"), k, F.lit("\t"), F.col("p_brand"), F.lit("; kinase"))
    entries = F.array(F.concat(F.lit("hsa1  "), F.col("p_type")), F.concat(F.lit("hsa2 "), F.col("p_name")))
    return t(spark, sf_dir, "part").select("p_partkey", R.gene_of_token(token, genes).alias("symbol"), R.without_id(entries, "; ").alias("pathway"))


@query(
    """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '1' ELSE array_to_string(list_transform(ws[1:2], lambda w: CASE w WHEN 'red' THEN 2 WHEN 'ring' THEN 3 WHEN 'small' THEN 4 ELSE 1 END), ',') END AS ids FROM w
"""
)
def vocabulary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.create_map(*(F.lit(x) for pair in {"red": 2, "ring": 3, "small": 4}.items() for x in pair))
    text = F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.col("p_name"))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(R.encoded(text, places, most=2), lambda i: i.cast("string")), ",").alias("ids"))


@query(
    """
WITH e AS (SELECT p_type, string_agg(p_name || ' ' || p_brand || chr(10) || chr(10), '' ORDER BY p_partkey) AS x FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part) WHERE r <= 2 GROUP BY p_type)
SELECT p_partkey, 'The following are questions about ' || replace(p_type, '_', ' ') || '.' || chr(10) || chr(10) || x || p_name AS prompt FROM part JOIN e USING (p_type)
"""
)
def few_shot_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part asked after the first two of its type."""
    from lakeloom.operators.sampling import ranked_in_group

    p = t(spark, sf_dir, "part")
    first = ranked_in_group(p.select("p_type", "p_partkey", F.col("p_name").alias("question"), F.col("p_brand").alias("answer")), "p_type", "p_partkey").where("rank < 2")
    shots = first.groupBy("p_type").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "question", "answer"))).alias("shots"))
    return p.join(shots, "p_type").select("p_partkey", R.with_examples(F.col("shots"), F.col("p_name"), F.col("p_type")).alias("prompt"))


@query(
    """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN to_timestamp(user_id) AT TIME ZONE 'UTC' WHEN 1 THEN ts::TIMESTAMP - INTERVAL 7 DAY WHEN 2 THEN TIMESTAMP '2024-02-03 00:00:00' END AS since FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)
"""
)
def since_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    spec = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, "now-7d").when(k == 2, "2024-02-03").otherwise("soon")
    return t(spark, sf_dir, "events").select("event_id", R.since(spec, F.col("ts")).cast("timestamp_ntz").alias("since"))


@query(
    """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{' || regexp_replace(trim(props), '^\\{|\\}$', '', 'g') || ',' ELSE '{' END || '"_origin":{"source":"' || event_type || '","key":"' || user_id || '"}}' AS metadata FROM events
"""
)
def with_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    given = F.when(k == 0, F.col("props")).when(k == 1, "{}").otherwise("[1")
    return t(spark, sf_dir, "events").select("event_id", R.with_provenance(given, {"source": F.col("event_type"), "key": F.col("user_id")}).alias("metadata"))


@query("SELECT p_partkey, coalesce(try_cast(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS DOUBLE), 'inf'::DOUBLE) AS key FROM part")
def number_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", R.number_key(F.col("p_brand")).alias("key"))
