"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Targets are in words. A source's target is shared among its documents by length class (shorter classes weigh a
little more), at most ``cap`` copies each: a document of class c is due e_c copies. floor(e_c) whole copies are
certain; for the rest each document has inclusion odds p / (1 - p), p = e_c - floor(e_c), and random odds
u / (1 - u) from a hash of its id. Documents are ranked by random odds / inclusion odds, and a source takes them
in that order up to its target; what is left after the last that fits goes, in the same order, to documents that
are no longer than the rest. Both ends are single numbers a source (``cut`` and ``refill``), so a document's copies
follow from its own row and its source's: no text is shuffled, and a hot source is never ordered in one task.
The ends are found by a histogram of ``BINS`` rank bins a source and an ordering of the ranks in one bin.

Rows with the same id and size have one rank. Where an end falls among such rows, as many of them are taken as fit
(``cut_some`` and ``refill_some``); only they are numbered, in ``SLOTS`` shares of their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import drop_saved, saved, spread_join

BINS = 4096
#: Shares in which tied rows are numbered.
SLOTS = 256
#: Weight of length class c (bits of the size, less one) is CLASS_WEIGHT - c.
CLASS_WEIGHT = 64
WORD = r"[^\x20\x09-\x0D]+"


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _class(size: Column) -> Column:
    return (F.length(F.bin(size)) - 1).cast("int")


def _uniform(id_: Column, size: Column, seed: int) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("-")), size.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)


def _filled(df: DataFrame, by: list[str], total: str, weight: str, most: str, order: list[Column], rate: str) -> DataFrame:
    """Adds ``rate``: the share of ``total`` a unit of weight gets once no row is above its own ``most``; and ``full``."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(*by)
    df = df.withColumn("_used", F.coalesce(F.sum(most).over(before), F.lit(0.0))).withColumn("_open", F.sum(weight).over(onward))
    df = df.withColumn("full", (F.col(total) - F.col("_used")) * F.col(weight) >= F.col(most) * F.col("_open"))
    rest = F.col(total) - F.coalesce(F.sum(F.when(F.col("full"), F.col(most))).over(every), F.lit(0.0))
    return df.withColumn(rate, rest / F.sum(F.when(~F.col("full"), F.col(weight))).over(every)).drop("_used", "_open")


def _end(ranked: DataFrame, room: DataFrame) -> DataFrame:
    """(source, end, tie, some, left): up to which rank a source's documents fit into its room, the next rank, how many of
    its rows still fit, and what is then left of the room.

    ranked has source, size and q; room has source and room."""
    ranked = ranked.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))
    hist = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("q").alias("top"))
    up_to = Window.partitionBy("source").orderBy("bin")
    hist = _beside(hist.withColumn("cum", F.sum("words").over(up_to)), room)
    whole = hist.where("cum <= room").groupBy("source").agg(F.max("top").alias("end"), F.max("cum").alias("words"))
    edge = hist.where("cum > room").groupBy("source").agg(F.min("bin").alias("edge"))
    state = room
    for part in (whole, edge):
        state = _beside(state, part, "left")
    state = saved(state.select("source", "room", F.coalesce("end", F.lit(-1.0)).alias("end"), F.coalesce("words", F.lit(0)).alias("words"), "edge"))
    in_order = Window.partitionBy("source").orderBy("q")
    inside = _beside(ranked, state, "inner").where("bin = edge").groupBy("source", "q", "room", "words").agg(F.sum("size").alias("own"), F.max("size").alias("size"))
    inside = inside.withColumn("cum", F.col("words") + F.sum("own").over(in_order))
    fits = inside.where("cum <= room").groupBy("source").agg(F.max("q").alias("last"), F.max("cum").alias("most"))
    over = inside.where("cum > room").groupBy("source").agg(F.min(F.struct("q", "size")).alias("next"))
    out = _beside(_beside(state, fits, "left"), over, "left").withColumn("left", F.col("room") - F.coalesce("most", "words"))
    out = out.withColumn("some", F.coalesce(F.floor(F.col("left") / F.col("next.size")), F.lit(0)).cast("long"))
    left = F.col("left") - F.col("some") * F.coalesce(F.col("next.size"), F.lit(0))
    return out.select("source", F.coalesce("last", "end").alias("end"), F.col("next.q").alias("tie"), "some", left.alias("left"))


def _beside(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a and b joined on source, where null equals null."""
    b = b.withColumnRenamed("source", "_source")
    return a.join(b, a["source"].eqNullSafe(b["_source"]), how).drop("_source")


def _plan(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int, seed: int) -> DataFrame:
    """A row for each source and length class: what decides on a document's copies. sizes: id, source, size."""
    classes = saved(sizes.withColumn("class", _class(F.col("size"))).groupBy("source", "class").agg(F.sum("size").alias("class_size")))
    sources = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    sources = sources.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share)).withColumn("most", F.col("source_size").cast("double") * cap)
    sources = _filled(sources, [], "total", "weight", "most", [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()], "rate")
    sources = saved(sources.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("rate")).alias("target")))

    due = _beside(classes.where("class_size > 0"), sources.select("source", "target"))
    due = due.withColumn("class_weight", (CLASS_WEIGHT - F.col("class")).cast("double")).withColumn("weight", F.col("class_weight") * F.col("class_size")).withColumn("most", F.col("class_size").cast("double") * cap)
    due = _filled(due, ["source"], "target", "weight", "most", [F.col("class")], "rate")
    due = due.withColumn("due", F.when(F.col("full"), F.lit(float(cap))).otherwise(F.col("class_weight") * F.col("rate")))
    due = saved(due.select("source", "class", "class_size", "target", F.floor("due").cast("int").alias("certain"), (F.col("due") - F.floor("due")).alias("p")))

    room = due.groupBy("source").agg((F.max("target") - F.sum(F.col("certain") * F.col("class_size"))).alias("room"))
    ranked = sizes.where("size > 0").withColumn("class", _class(F.col("size")))
    marks = due.where("p > 0").select(F.col("source").alias("_source"), F.col("class").alias("_class"), "p")
    ranked = ranked.join(marks, ranked["source"].eqNullSafe(marks["_source"]) & (ranked["class"] == marks["_class"]))
    ranked = saved(ranked.select("source", "size", _rank(F.col("id"), F.col("size"), F.col("p"), seed).alias("q")))
    cut = saved(_end(ranked, room).select("source", F.col("end").alias("cut"), F.col("tie").alias("cut_tie"), F.col("some").alias("cut_some"), F.col("left").alias("gap")))
    later = _beside(ranked, cut).where("q > cut and size <= gap").select("source", "size", "q")
    refill = _end(later, cut.select("source", F.col("gap").alias("room"))).select("source", F.col("end").alias("refill"), F.col("tie").alias("refill_tie"), F.col("some").alias("refill_some"))
    plan = _beside(due.drop("target", "class_size"), _beside(cut, refill, "left"))
    plan = _beside(sources.select("source", "source_size", "target"), plan, "left")
    plan = saved(plan)
    drop_saved(classes, sources, due, ranked, cut)
    return plan


def _rank(id_: Column, size: Column, p: Column, seed: int) -> Column:
    u = _uniform(id_, size, seed)
    return (u / (1 - u)) / (p / (1 - p))


def _decided(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows (id, source, size and others) with source_size, target and copies."""
    columns = rows.columns
    totals = plan.groupBy("source").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    ends = ["cut", "cut_tie", "cut_some", "gap", "refill", "refill_tie", "refill_some"]
    marks = plan.select(F.col("source").alias("_source"), F.col("class").alias("_class"), "certain", "p", *ends).where("_class is not null")
    rows = _beside(rows, totals, "left").withColumn("class", _class(F.col("size")))
    rows = rows.join(marks, rows["source"].eqNullSafe(marks["_source"]) & (rows["class"] == marks["_class"]) & (rows["size"] > 0), "left")
    rows = rows.withColumn("q", F.when(F.col("p") > 0, _rank(F.col("id"), F.col("size"), F.col("p"), seed)))
    drawn = (F.col("q") <= F.col("cut")) | ((F.col("size") <= F.col("gap")) & (F.col("q") <= F.col("refill")))
    some = F.when((F.col("q") == F.col("cut_tie")) & (F.col("cut_some") > 0), F.col("cut_some")).when((F.col("q") == F.col("refill_tie")) & (F.col("size") <= F.col("gap")) & (F.col("refill_some") > 0), F.col("refill_some"))
    rows = rows.withColumn("_some", some).select(*columns, "source_size", "target", "certain", drawn.alias("_drawn"), "q", "_some")
    if not plan.where("cut_some > 0 or refill_some > 0").isEmpty():
        rows = rows.where("_some is null").unionByName(_first_of_tied(rows.where("_some is not null")))
    return rows.withColumn("copies", F.coalesce(F.col("certain") + F.when(F.col("_drawn"), 1).otherwise(0), F.lit(0)).cast("int")).drop("certain", "_drawn", "q", "_some")


def _first_of_tied(rows: DataFrame) -> DataFrame:
    """Of the rows of each rank, the first ``_some`` by a digest of all their columns are drawn; of rows that are alike in
    every column it does not matter which."""
    own = [c for c in rows.columns if not c.startswith("_") and c != "q"]
    rows = saved(rows.withColumn("_digest", F.sha2(F.to_json(F.struct(*own)).cast("binary"), 256)).withColumn("_slot", F.pmod(F.monotonically_increasing_id(), F.lit(SLOTS)).cast("int")))
    # by digest: how many rows come before, in runs of digests that begin alike
    per = rows.groupBy("source", "q", "_digest").agg(F.count(F.lit(1)).alias("_n"), F.max("_some").alias("_of")).withColumn("_run", F.substring("_digest", 1, 2))
    before = lambda by, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = per.groupBy(F.col("source").alias("_a"), F.col("q").alias("_b"), F.col("_run").alias("_c")).agg(F.sum("_n").alias("_n"))
    runs = runs.select("_a", "_b", "_c", before(["_a", "_b"], "_c").alias("_earlier"))
    per = per.withColumn("_inside", before(["source", "q", "_run"], "_digest")).join(runs, F.col("source").eqNullSafe(F.col("_a")) & (F.col("q") == F.col("_b")) & (F.col("_run") == F.col("_c")))
    per = per.select("_digest", "_n", F.least(F.col("_n"), F.greatest(F.lit(0), F.col("_of") - F.col("_earlier") - F.col("_inside"))).alias("_take"))
    # rows alike, of which some are drawn, are numbered in slots
    slots = rows.groupBy("_digest", "_slot").agg(F.count(F.lit(1)).alias("_n")).select("_digest", "_slot", before(["_digest"], "_slot").alias("_before"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_digest", "_slot").orderBy("size"))).join(slots, ["_digest", "_slot"])
    numbered = spread_join(numbered, per.select("_digest", "_take"), "_digest", "_slot")
    return numbered.withColumn("_drawn", F.col("_k") + F.col("_before") <= F.col("_take")).drop("_digest", "_slot", "_take", "_k", "_before")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 17
) -> DataFrame:
    """(id_col, size, source_size, target, copies, taken) for each row of ``docs``.

    size: words (runs of characters other than 0x20 and 0x09-0x0D; 0 for null texts). Sources by code point, null
    last, take ``weights`` in turn and share ``share`` of all sizes; a target stops at ``cap`` times its source's
    size, and the excess goes to the others by weight. taken = copies * size, copies <= cap; a source's taken words
    fall short of its target by less than the smallest document that was passed over for want of room.
    Null sources are a source; null ids count as one id; texts without words get no copies; of rows with the same id
    and size, which have the same rank, as many are taken as fit, in the order of a digest of
    their columns; an empty table gives an empty result. The seed fixes
    how many of each are taken. Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), _size(F.col(text_col).cast("string")).alias("size"))
    sizes = saved(rows)
    out = _decided(sizes, _plan(sizes, weights, share, cap, seed), seed)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, with its columns, each as often as mix_sources() takes it (not at all where that is never)."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), _size(F.col(text_col).cast("string")).alias("size"))
    sizes = saved(rows.select("id", "source", "size"))
    plan = _plan(sizes, weights, share, cap, seed)
    drop_saved(sizes)
    taken = _decided(rows, plan, seed).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


#: The same for DuckDB, for the default parameters.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id AS id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), k AS (
  SELECT *, CAST(length(bin(size)) - 1 AS INT) AS class FROM d
), c AS (
  SELECT source, class, CAST(sum(size) AS BIGINT) AS class_size FROM k GROUP BY source, class
), s0 AS (
  SELECT source, CAST(sum(class_size) AS BIGINT) AS source_size FROM c GROUP BY source
), s1 AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS weight,
    CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total, CAST(source_size AS DOUBLE) * 2 AS most FROM s0
), s2 AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s1
), s3 AS (
  SELECT *, (total - used) * weight >= most * open AS isfull FROM s2
), s AS (
  SELECT source, source_size, CASE WHEN isfull THEN most ELSE weight * ((total - coalesce(sum(CASE WHEN isfull THEN most END) OVER (), 0)) / sum(CASE WHEN NOT isfull THEN weight END) OVER ()) END AS target FROM s3
), e0 AS (
  SELECT c.source, class, class_size, target, CAST(64 - class AS DOUBLE) AS cw, CAST(64 - class AS DOUBLE) * class_size AS weight, CAST(class_size AS DOUBLE) * 2 AS most
  FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source WHERE class_size > 0
), e1 AS (
  SELECT *, coalesce(sum(most) OVER (PARTITION BY source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER (PARTITION BY source ORDER BY class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM e0
), e2 AS (
  SELECT *, (target - used) * weight >= most * open AS isfull FROM e1
), e3 AS (
  SELECT *, CASE WHEN isfull THEN 2.0::DOUBLE ELSE cw * ((target - coalesce(sum(CASE WHEN isfull THEN most END) OVER (PARTITION BY source), 0)) / sum(CASE WHEN NOT isfull THEN weight END) OVER (PARTITION BY source)) END AS due FROM e2
), e AS (
  SELECT source, class, class_size, target, CAST(floor(due) AS INT) AS certain, due - floor(due) AS p FROM e3
), room AS (
  SELECT source, max(target) - sum(certain * class_size) AS room FROM e GROUP BY source
), u AS (
  SELECT k.*, certain, p, (CAST('0x' || substr(md5('17:' || coalesce(CAST(id AS VARCHAR), '-') || ':' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM k LEFT JOIN e ON k.source IS NOT DISTINCT FROM e.source AND k.class = e.class AND k.size > 0
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM u
), f AS (
  SELECT q.source, q, size, room, sum(size) OVER (PARTITION BY q.source ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM q JOIN room ON q.source IS NOT DISTINCT FROM room.source WHERE q IS NOT NULL
), cut AS (
  SELECT room.source, coalesce(max(q) FILTER (cum <= room.room), -1) AS cut, min(q) FILTER (cum > room.room) AS tie, arg_min(size, q) FILTER (cum > room.room) AS tie_size,
    max(room.room) - coalesce(max(cum) FILTER (cum <= room.room), 0) AS rest
  FROM room LEFT JOIN f ON room.source IS NOT DISTINCT FROM f.source GROUP BY room.source
), cut_ends AS (
  SELECT source, cut, tie, CAST(coalesce(floor(rest / tie_size), 0) AS BIGINT) AS some, rest - CAST(coalesce(floor(rest / tie_size), 0) AS BIGINT) * coalesce(tie_size, 0) AS gap FROM cut
), f2 AS (
  SELECT q.source, q, size, gap, sum(size) OVER (PARTITION BY q.source ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM q JOIN cut_ends c ON q.source IS NOT DISTINCT FROM c.source WHERE q > cut AND size <= gap
), refill AS (
  SELECT source, max(q) FILTER (cum <= gap) AS refill, min(q) FILTER (cum > gap) AS tie, floor((max(gap) - coalesce(max(cum) FILTER (cum <= gap), 0)) / (arg_min(size, q) FILTER (cum > gap))) AS some
  FROM f2 GROUP BY source
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source, q) AS k FROM q
), t AS (
  SELECT n.id, n.size, n.source, coalesce(certain + CASE WHEN n.q <= cut OR (n.q = c.tie AND k <= c.some) OR (n.size <= gap AND (n.q <= refill OR (n.q = r.tie AND k <= r.some))) THEN 1 ELSE 0 END, 0) AS copies
  FROM n LEFT JOIN cut_ends c ON n.source IS NOT DISTINCT FROM c.source LEFT JOIN refill r ON n.source IS NOT DISTINCT FROM r.source
)
SELECT id AS doc_id, size, source_size, target, CAST(copies AS INT) AS copies, CAST(copies * size AS BIGINT) AS taken
FROM t JOIN s ON t.source IS NOT DISTINCT FROM s.source
"""
