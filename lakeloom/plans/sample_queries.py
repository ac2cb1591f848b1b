"""Further queries: samples from raw records, draws from mixtures, joins with rules. Registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import samples as S
from lakeloom.functions import similarity
from lakeloom.operators import audit, matching, sampling
from lakeloom.plans.queries import next_turn_pairs, query, r6, t
from lakeloom.sources.manifests import discovered, shard_names


@query(
    """
WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS ms, min(text) AS one FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, one, CASE conv_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ms[1:1] ELSE ms END AS ms FROM c)
SELECT conv_id, CASE WHEN len(ms) >= 2 THEN array_to_string(list_transform(ms, lambda m: m.role || ': ' || m.text), chr(10))
  WHEN ms IS NULL AND conv_id % 2 = 0 THEN concat('<points coords="1 1 ', CASE WHEN conv_id <= 100 THEN conv_id * 10 ELSE conv_id END, ' ', CASE WHEN conv_id <= 100 THEN 70 ELSE 7 END, '">conv</points>')
  WHEN trim(one) = '' THEN 'An image.' ELSE one END AS text,
  CASE WHEN len(ms) >= 2 THEN 'pointing_conversation' WHEN ms IS NULL AND conv_id % 2 = 0 THEN 'pointing_pixmo' ELSE 'caption' END AS kind FROM k
"""
)
def sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three conversations one has no turns (and every other of those a point), one a single turn, one all of them."""
    d = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("ms"), F.min("text").alias("one"))
    turns = F.transform("ms", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    kind, c = F.col("conv_id") % 3, F.col("conv_id")
    turns = F.when(kind == 1, F.slice(turns, 1, 1)).when(kind == 2, turns)
    points = F.when(c % 2 == 0, F.array(F.struct(c.cast("double").alias("x"), F.lit(7.0).alias("y"))))
    return d.select("conv_id", S.sample_text(turns, points, F.lit("conv"), F.col("one")).alias("s")).select("conv_id", "s.text", "s.kind")


_NUMBERS = "CASE l_linenumber % 4 WHEN 0 THEN concat('[', l_partkey, ', ', l_suppkey, ']') WHEN 1 THEN concat(l_partkey, ';', l_suppkey) WHEN 2 THEN concat(l_partkey, ' x') ELSE concat(l_partkey, ' ', l_suppkey) END"


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 4 <> 2 THEN 2 END AS BIGINT) AS n, CAST(CASE WHEN l_linenumber % 4 <> 2 THEN l_partkey + l_suppkey END AS DOUBLE) AS total FROM lineitem")
def number_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.number_list(F.expr(_NUMBERS)).alias("v"))
    return d.select("l_orderkey", "l_linenumber", F.when(F.col("v").isNotNull(), F.size("v")).cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT l_orderkey, 'line | part' || chr(10) || string_agg(concat(l_linenumber, ' | ', left(concat('P', l_partkey * 1000), 5)), chr(10) ORDER BY l_linenumber, l_partkey) AS text FROM lineitem GROUP BY l_orderkey")
def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("l_linenumber", "l_partkey", F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit("P"), (F.col("l_partkey") * 1000).cast("string"))).alias("cells"))
    d = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # the lines of one order
    return d.select("l_orderkey", S.table_text(F.array(F.lit("line"), F.lit("part")), F.col("rows.cells"), 5).alias("text"))


@query(r"SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('/abs/', page_id) WHEN 1 THEN concat('/data/images/', page_id, '.png') ELSE '/data/' || regexp_extract(url, '[^/]*$') END AS path FROM pages")
def repaired_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = F.expr("CASE page_id % 3 WHEN 0 THEN concat('/abs/', page_id) WHEN 1 THEN concat('old/images/older/images/', page_id, '.png') ELSE url END")
    return t(spark, sf_dir, "pages").select("page_id", S.repaired_path(stale, "/data/").alias("path"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN trim(props) END AS found FROM events")
def json_in_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('Here:\\n```json\\n', props, '\\n```\\nas asked') WHEN 2 THEN concat('so: ', props, ' it is') ELSE 'no answer' END")
    return t(spark, sf_dir, "events").select("event_id", S.loose_json(said).alias("found"))


@query(
    r"""
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s[1] AS opening, sha256(array_to_string(s[1:3], chr(10))) AS first_three FROM d
"""
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", S.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", 0).alias("opening"), F.sha2(F.array_join(F.slice("s", 1, 3), "\n").cast("binary"), 256).alias("first_three"))


_SHARE = "('0x' || substr(sha256({0}), 1, 8))::BIGINT / 4294967296::DOUBLE"


@query(
    f"""
WITH d AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents WHERE source IS NOT NULL GROUP BY source),
c AS (SELECT source, n, sum(w) OVER (ORDER BY source) / sum(w) OVER () AS hi, (sum(w) OVER (ORDER BY source) - w) / sum(w) OVER () AS lo FROM d),
u AS (SELECT i AS draw, {_SHARE.format("'11:' || i")} AS u, {_SHARE.format("'12:' || i")} AS v FROM (SELECT unnest(range(10000)) AS i))
SELECT draw, source AS dataset, CAST(floor(v * n) AS BIGINT) AS place FROM u JOIN c ON u >= lo AND u < hi
"""
)
def mixture_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 draws with replacement, a source by the root of its rows."""
    sizes = t(spark, sf_dir, "documents").where("source is not null").groupBy("source").count().collect()  # a row a source
    return sampling.draws(spark, [(r[0], r[1] ** 0.5, r[1]) for r in sorted(sizes)], 10_000, 11)


@query(
    f"""
WITH k AS (SELECT doc_id, source, -ln(1 - {_SHARE.format("'5:' || doc_id")}) / CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 0.5 ELSE 1 END::DOUBLE AS k FROM documents),
o AS (SELECT doc_id, source, row_number() OVER (ORDER BY k, doc_id) - 1 AS idx FROM k)
SELECT doc_id, source, CAST(idx AS BIGINT) AS idx FROM o WHERE idx <= (SELECT min(m) FROM (SELECT max(idx) AS m FROM o GROUP BY source))
"""
)
def weighted_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.interleaved(d, "source", {"src0": 3.0, "src1": 0.5}, "doc_id", seed=5, until_first_ends=True)


@query(
    """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source FROM r WHERE r <= greatest(1, floor(n * 0.1::DOUBLE))
"""
)
def proportion_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.prefix_share(t(spark, sf_dir, "documents").select("doc_id", "source"), "source", 0.1, "doc_id")


@query(
    """
WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), s AS (SELECT l_orderkey, unnest(range(n)) AS step FROM l)
SELECT CAST(row_number() OVER (ORDER BY l_orderkey, step) - 1 AS BIGINT) AS idx, l_orderkey, CAST(step AS BIGINT) AS step FROM s
"""
)
def episode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return sampling.steps_of(lengths, "l_orderkey", "n")


@query(
    """
WITH n AS (SELECT concat(CASE WHEN n_nationkey % 2 = 0 THEN 'a/' ELSE 'b/' END, n_nationkey, '.png') AS file, n_name FROM nation), e AS (SELECT event_id, concat('a/', event_id % 50, '.png') AS path FROM events)
SELECT event_id, path, coalesce(x.n_name, y.n_name) AS n_name, CASE WHEN x.file IS NOT NULL THEN 'path' WHEN y.file IS NOT NULL THEN 'name' ELSE 'none' END AS how
FROM e LEFT JOIN n x ON x.file = path LEFT JOIN n y ON split_part(y.file, '/', 2) = split_part(path, '/', 2)
"""
)
def path_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = t(spark, sf_dir, "nation").select(F.expr("concat(CASE WHEN n_nationkey % 2 = 0 THEN 'a/' ELSE 'b/' END, n_nationkey, '.png')").alias("file"), "n_name")
    rows = t(spark, sf_dir, "events").select("event_id", F.expr("concat('a/', event_id % 50, '.png')").alias("path"))
    return matching.by_path(rows, "path", files, "file", "n_name")


@query(
    """
WITH o AS (SELECT o_custkey, count(*) AS found, min(o_orderkey) AS o FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(found, 0) AS found, CASE WHEN found IS NULL THEN 'unresolved' WHEN found > 12 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN found <= 12 THEN o END AS o_orderkey FROM customer LEFT JOIN o ON o_custkey = c_custkey
"""
)
def lookup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return matching.resolved(t(spark, sf_dir, "customer").select("c_custkey"), found, "c_custkey", "o_orderkey", 12)


@query(
    """
WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT c_custkey AS user_id, event_type, value FROM customer LEFT JOIN (SELECT * FROM e WHERE r = 1) ON c_custkey = user_id
"""
)
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return matching.with_latest(rows, t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query(
    """
SELECT l_partkey, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS l_suppkey, count(DISTINCT l_suppkey) AS "values" FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) AND l_partkey IN (SELECT ps.l_partkey FROM lineitem ps WHERE l_quantity > 40) GROUP BY l_partkey
"""
)
def agreed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem")
    even = t(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"))
    return matching.agreed(lines.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", even, lines.where("l_quantity > 40"))


@query(
    """
WITH g AS (SELECT user_id, seed FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([0, 1, 2, 3]) AS seed)), s AS (SELECT user_id, event_id % 4 AS seed, avg(value) AS v FROM events WHERE event_id % 7 > 4 GROUP BY 1, 2)
SELECT CAST(seed AS INT) AS seed, count(*) AS cases, CAST(sum((v IS NULL)::INT) AS BIGINT) AS failed, round(avg(coalesce(v, 0)), 4) AS mean FROM g LEFT JOIN s USING (user_id, seed) GROUP BY seed
"""
)
def qualification_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    scores = e.where("event_id % 7 > 4").select("user_id", (F.col("event_id") % 4).cast("int").alias("seed"), "value")
    grid = matching.complete_grid(e.select("user_id").distinct(), {"seed": [0, 1, 2, 3]}, scores, "value")
    return grid.groupBy("seed").agg(F.count(F.lit(1)).alias("cases"), F.sum(F.col("failed").cast("long")).alias("failed"), F.round(F.avg("value"), 4).alias("mean"))


@query(
    """
WITH m AS (SELECT replace(o_orderpriority, ' ', '-') || '-' || o_orderkey AS dataset, o_orderkey % 5 AS train, o_custkey % 3 AS val FROM orders), s AS (SELECT *, unnest(range(train + val)) AS k FROM m)
SELECT dataset, CASE WHEN k < train THEN 'train' ELSE 'val' END AS split, CAST(k AS INT) AS k, printf('%s-%06d.tar', dataset, k) AS name FROM s
"""
)
def manifest_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("-", F.translate("o_orderpriority", " ", "-"), F.col("o_orderkey").cast("string"))
    m = t(spark, sf_dir, "orders").select(name.alias("dataset"), (F.col("o_orderkey") % 5).cast("int").alias("train"), (F.col("o_custkey") % 3).cast("int").alias("val"))
    return shard_names(m, "dataset", "train", "val")


@query(
    """
WITH o AS (SELECT 'set_' || o_orderkey AS dataset, o_orderkey AS i FROM orders),
f AS (SELECT dataset, i, unnest(CASE WHEN i % 3 = 0 THEN ['a.tar', 'c.tar', 'b.tar'] WHEN i % 2 = 0 THEN ['shard-000000.tar', 'shard-000001.tar'] ELSE ['set-' || i || '-000000.tar', 'set-' || i || '-000001.tar'] END) AS name FROM o),
n AS (SELECT dataset, i, CASE WHEN i % 3 = 0 AND i % 7 <> 0 THEN ['c.tar', 'gone.tar', 'a.tar', 'b.tar'][1:CASE WHEN i % 5 = 0 THEN 4 ELSE 3 END] WHEN i % 7 = 0 THEN (CASE WHEN i % 3 = 0 THEN ['a.tar', 'b.tar', 'c.tar'] WHEN i % 2 = 0 THEN ['shard-000000.tar', 'shard-000001.tar'] ELSE ['set-' || i || '-000000.tar', 'set-' || i || '-000001.tar'] END)
  WHEN i % 2 = 0 THEN ['shard-000000.tar', 'shard-000001.tar', 'shard-000002.tar'] ELSE ['set-' || i || '-000000.tar', 'set-' || i || '-000001.tar', 'set-' || i || '-000002.tar'] END AS names FROM o),
u AS (SELECT dataset, unnest(names) AS name, generate_subscripts(names, 1) AS k FROM n)
SELECT u.dataset, CAST(row_number() OVER (PARTITION BY u.dataset ORDER BY k) - 1 AS INT) AS k, u.name FROM u JOIN f ON f.dataset = u.dataset AND f.name = u.name
"""
)
def discovered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets whose manifests list their shards, count them under one name or another, or say nothing."""
    i, null = F.col("o_orderkey"), F.lit(None)
    tar = lambda *names: F.array(*(F.lit(f"{n}.tar") for n in names))
    own = lambda *ks: F.array(*(F.format_string(f"set-%d-{k:06d}.tar", i) for k in ks))
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("set_"), i.cast("string")).alias("dataset"))
    files = o.select("dataset", F.explode(F.when(i % 3 == 0, tar("a", "c", "b")).when(i % 2 == 0, tar("shard-000000", "shard-000001")).otherwise(own(0, 1))).alias("name"))
    silent = i % 7 == 0
    manifests = o.select(
        "dataset", F.when((i % 3 == 0) & ~silent, tar("c", "gone", "a", "b")).alias("shards"), F.when((i % 5 == 0) & ~silent, 3).alias("num_train_shards"), F.when((i % 3 != 0) & ~silent & (i % 5 != 0), 3).alias("num_shards"), null.cast("int").alias("train_shards"), null.cast("int").alias("total_shards"), F.lit(3).alias("configured")
    )
    return discovered(manifests, files).select("dataset", "k", "name")


@query(
    """
WITH d AS (SELECT sha256(concat('+', doc_id, chr(31), coalesce('+' || lang, '-'), chr(31), coalesce('+' || source, '-'))) AS h FROM documents),
c AS (SELECT left(h, 2) AS b, h || ':' || count(*) AS h, count(*) AS n FROM d GROUP BY d.h), b AS (SELECT sha256(string_agg(b || '=' || h, ',' ORDER BY b || '=' || h)) AS h, sum(n) AS n FROM c GROUP BY b)
SELECT sha256(sha256(string_agg('=' || h, ',' ORDER BY h))) AS fingerprint, CAST(sum(n) AS BIGINT) AS rows FROM b
"""
)
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.fingerprint(t(spark, sf_dir, "documents"), ["doc_id", "lang", "source"], digits=2)


@query()
def matching_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of matching blocks of neighbouring turns, by words and by characters."""
    d = next_turn_pairs(spark, sf_dir)
    return d.select("conv_id", "turn", r6(similarity.block_f1("text", "next_text")).alias("by_words"), r6(similarity.ratio("text", "next_text")).alias("by_characters"))


@query()
def edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns each part's type into its name."""
    return t(spark, sf_dir, "part").select("p_partkey", similarity.edit_counts(F.lower("p_type"), F.col("p_name")).alias("e")).select("p_partkey", "e.*")
