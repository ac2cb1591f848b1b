"""Row filters and rules. A filter is a predicate column; a rule is a named predicate, and reports count what breaks it."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import stripped, word_count
from lakeloom.sources.scratch import Scratch

# Extensions of images in samples.
IMAGES = ("jpg", "jpeg", "png", "webp")
# The block size of tar files, and the largest member an index may point at.
TAR_BLOCK, TAR_MEMBER_MAX = 512, 128 * 1024 * 1024


# ---- filters -----------------------------------------------------------------------------------------------------


def has_image_and_text(extensions: Column) -> Column:
    return F.exists(extensions, lambda e: e.isin(*IMAGES)) & F.array_contains(extensions, "txt")


def located(status: Column, place: Column, kept: tuple[str, ...] = ("resolved", "ambiguous")) -> Column:
    """A kept status and a place that is not blank; null counts as no."""
    return F.coalesce(status.isin(*kept) & (stripped(place) != ""), F.lit(False))


def complete(*required: Column) -> Column:
    """No required text is null or blank."""
    return reduce(lambda a, b: a & b, (F.coalesce(stripped(c.cast("string")) != "", F.lit(False)) for c in required))


def in_budget(caption: Column, least: int, most: int, metadata: Column, max_bytes: int, source: Column) -> Column:
    """A caption of least to most words, metadata of at most so many bytes, and a source that is named."""
    n = word_count(caption)
    return n.between(least, most) & (F.coalesce(F.octet_length(metadata), F.lit(0)) <= max_bytes) & complete(source)


def equal_fields(df: DataFrame, wanted: Mapping[str, str]) -> Column:
    """Every wanted field equals its value as text; a missing field or value compares as "None"."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("None")) if name in df.columns else F.lit("None")
    return reduce(lambda a, b: a & b, (text(k) == v for k, v in wanted.items()), F.lit(True))


def usable_number(value: Column, positive: bool = True) -> Column:
    """A finite number (text is tried as one), above 0 if ``positive``; null counts as no."""
    n = value.cast("string").try_cast("double")
    fine = ~F.isnan(n) & (F.abs(n) < F.lit(math.inf))
    return F.coalesce(fine & (n > 0) if positive else fine, F.lit(False))


def eligible_budgets(cells: DataFrame, backbone: str, budget: str, least_mid: float = 1e19) -> DataFrame:
    """The cells (backbone, budget) that fit the backbone's size, read from the end of its name: small and unknown ones
    take all budgets, middling ones those from ``least_mid`` on, large ones the two highest."""
    size = F.regexp_extract(backbone, r"-(\d+(?:\.\d+)?B)$", 1)
    top = cells.select(F.col(budget).alias("_b")).distinct().orderBy(F.desc("_b")).limit(2).agg(F.coalesce(F.min("_b"), F.lit(math.inf)).alias("_top"))
    fits = F.when(size.isin("4B", "7B", "8B"), F.col(budget) >= least_mid).when(size.isin("14B", "32B"), F.col(budget) >= F.col("_top")).otherwise(True)
    return cells.join(F.broadcast(top)).where(fits).drop("_top")  # one row


def usable_episodes(episodes: DataFrame, index: str, length: str, present: Column, instruction: Column, chunk: int = 1000, chunks: int = 20) -> DataFrame:
    """Adds reason: null for a usable episode, else the first of chunk (beyond the cap), file, length (< 2 steps) and
    instruction (blank) that it lacks."""
    checks = [("chunk", F.floor(F.col(index) / chunk) <= chunks), ("file", present), ("length", F.col(length) >= 2), ("instruction", complete(instruction))]
    return episodes.withColumn("reason", F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks)))


def compatible(presets: DataFrame, designs: DataFrame, needs: str, offers: str, requires: str) -> DataFrame:
    """Pairs of a preset and a design in which the design offers all the preset needs, and the preset has all the design
    requires. Neither side is sent to all tasks: a preset meets the designs that offer the one of its needs which the
    fewest offer, and those pairs are looked at whole. A preset without needs meets the designs that require nothing."""
    scratch = Scratch(presets.sparkSession)
    left = scratch.saved(presets.withColumn("_l", F.monotonically_increasing_id()))
    right = scratch.saved(designs.withColumn("_r", F.monotonically_increasing_id()))
    offered = right.select("_r", F.explode(F.array_distinct(offers)).alias("_t")).where("_t is not null")
    needed = left.select("_l", F.explode(F.array_distinct(needs)).alias("_t")).where("_t is not null")
    rare = needed.join(offered.groupBy("_t").agg(F.count(F.lit(1)).alias("_n")), "_t", "left").groupBy("_l").agg(F.min_by("_t", F.struct(F.coalesce("_n", F.lit(0)), "_t")).alias("_t"))
    free = left.join(rare, "_l", "left_anti").select("_l").withColumn("_one", F.lit(1))
    pairs = rare.join(offered, "_t").select("_l", "_r").union(free.join(right.where(F.size(F.array_compact(requires)) <= 0).select("_r").withColumn("_one", F.lit(1)), "_one").select("_l", "_r"))
    met = left.join(pairs, "_l").join(right, "_r").where((F.size(F.array_except(F.array_compact(needs), offers)) == 0) & (F.size(F.array_except(F.array_compact(requires), needs)) == 0))
    return met.select(*presets.columns, *designs.columns)


def in_modalities(modality: Column, requested: list[str]) -> Column:
    """Whether a staged set's modality is among those asked for; none asked for lets all pass."""
    return F.coalesce(F.lower(modality).isin(*(m.lower() for m in requested)), F.lit(False)) if requested else F.lit(True)


def changed_since(rows: DataFrame, since: Column, sweep: str | None = None, wanted: str | None = None) -> DataFrame:
    """The rows of files changed at or after a time, of one sweep if it is named. rows: read from files by Spark."""
    kept = rows.where(F.col("_metadata.file_modification_time") >= since)
    return kept if sweep is None else kept.where(F.col(sweep) == wanted)


def retention(df: DataFrame, kept: Column, *by: str) -> DataFrame:
    """By group: rows, kept, and the share kept (0 without rows)."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.coalesce(kept.cast("long"), F.lit(0))), F.lit(0)).alias("kept"))
    return out.withColumn("share", F.coalesce(F.try_divide("kept", "rows"), F.lit(0.0)))


def first_failure(rules: Mapping[str, Column]) -> Column:
    """The name of the first rule that a row breaks (null counts as broken); null if it keeps all."""
    return F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in rules.items()))


def exclusions(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """reason, n: how many rows each rule is the first to exclude, and how many none does (kept)."""
    return df.groupBy(F.coalesce(first_failure(rules), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ---- validation --------------------------------------------------------------------------------------------------


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """key, rule: a row for each rule that a row of ``df`` breaks; a predicate that is null counts as broken."""
    broken = F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()))
    return df.select(key, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """key, n: keys that more than one row has."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def split_owners(df: DataFrame, kind: str, key: Column, split: str) -> DataFrame:
    """kind, key, splits: keys that lie in more than one split."""
    per = df.select(key.cast("string").alias("key"), split).where("key is not null").groupBy("key").agg(F.countDistinct(split).alias("splits"))
    return per.where("splits > 1").select(F.lit(kind).alias("kind"), "key", "splits")


def locator_rules(header: str, data: str, size: str, member: str, key: str, shard_bytes: str) -> dict[str, Column]:
    """Rules of an index row that points at a tar member: aligned header, data behind it, size and end in bounds, and the
    member's name."""
    h, d, n = F.col(header), F.col(data), F.col(size)
    return {
        "header": (h >= 0) & (h % TAR_BLOCK == 0),
        "data": d == h + TAR_BLOCK,
        "size": (n > 0) & (n <= TAR_MEMBER_MAX),
        "bounds": d + n <= F.col(shard_bytes),
        "member": (F.col(member) == F.concat(F.col(key), F.lit(".jpg"))) & ~F.col(member).rlike(r"[/\\]"),
    }


def description_rules(key: str, file: str, split: str, text: str) -> dict[str, Column]:
    """Rules of a described image: id ``{split}_{digits}``, file ``{id}.jpg``, a description that is not blank."""
    return {
        "id": F.col(key).rlike(r"^[a-z_]+_\d+$"),
        "split": F.regexp_replace(key, r"_\d+$", "") == F.col(split),
        "file": F.col(file) == F.concat(F.col(key), F.lit(".jpg")),
        "description": complete(F.col(text)),
    }


def case_rules(key: str, task: str, prompt: str, sources: str, seeds: str, group: str, split: str, width: str, height: str, seed_count: int = 3) -> dict[str, Column]:
    """Rules of an evaluation case that a row can be held to by itself."""
    n, s = F.size(sources), F.col(seeds)
    count = F.when(F.col(task) == "t2i", n == 0).when(F.col(task) == "edit", n >= 1).when(F.col(task) == "in_context", n >= 2).otherwise(False)
    return {
        "id": F.col(key).rlike(r"^[A-Za-z0-9_.-]+$") & ~F.col(key).isin(".", ".."),
        "task": F.col(task).isin("t2i", "edit", "in_context"),
        "prompt": complete(F.col(prompt)),
        "sources": count,
        "seeds": (F.size(s) == seed_count) & (F.size(F.array_distinct(s)) == seed_count) & F.forall(s, lambda x: x >= 0),
        "group": complete(F.col(group), F.col(split)),
        "size": (F.col(width) > 0) & (F.col(width) % 16 == 0) & (F.col(height) > 0) & (F.col(height) % 16 == 0),
    }


def sample_problems(parts: Column, required: tuple[str, ...] = ("text", "image")) -> Column:
    """The problems of a sample (extension -> content): missing_text, empty_text, missing_image, and missing_X or
    failed_X for each further required extension; an .npy part must hold a one-dimensional number array."""
    keys = F.map_keys(parts)
    text = F.coalesce(F.try_element_at(parts, F.lit("txt")), F.try_element_at(parts, F.lit("instruction.txt")))
    image = F.exists(keys, lambda k: k.isin(*IMAGES, "head.jpg", "wrist.jpg", "head.png", "wrist.png"))
    blank = stripped(F.decode(text, "UTF-8")) == ""
    found = []
    if "text" in required:
        found.append(F.when(text.isNull(), "missing_text").when(blank, "empty_text"))
    if "image" in required:
        found.append(F.when(~image, "missing_image"))
    for name in required:
        if name not in ("text", "image"):
            own = F.try_element_at(parts, F.lit(name))
            bad = F.lit(False) if not name.endswith(".npy") else ~is_number_array(own)
            found.append(F.when(own.isNull(), f"missing_{name}").when(bad, f"failed_{name}"))
    return F.filter(F.array(*found), lambda p: p.isNotNull())


def is_number_array(content: Column) -> Column:
    """Whether bytes begin as an .npy file of one dimension, of floats or integers, read from its header."""
    head = F.decode(F.substring(content, 11, 118), "ISO-8859-1")
    magic = F.hex(F.substring(content, 1, 6)) == "934E554D5059"
    return F.coalesce(magic & head.rlike(r"'descr':\s*'[<>|=][fiu]\d+'") & head.rlike(r"'shape':\s*\(\d+,\)"), F.lit(False))


def shard_report(samples: DataFrame, shard: str, parts: str, required: tuple[str, ...] = ("text", "image")) -> DataFrame:
    """By shard: samples, valid, and how many samples have each kind of problem, as a sorted text ``problem=n``."""
    rows = samples.select(shard, sample_problems(F.col(parts), required).alias("p"))
    n = rows.groupBy(shard).agg(F.count(F.lit(1)).alias("samples"), F.sum((F.size("p") == 0).cast("long")).alias("valid"))
    kinds = rows.select(shard, F.explode("p").alias("p")).groupBy(shard, "p").agg(F.count(F.lit(1)).alias("k"))
    told = kinds.groupBy(shard).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "p", F.col("k").cast("string")))), ",").alias("problems"))  # a row a kind
    return n.join(told, shard, "left").withColumn("problems", F.coalesce("problems", F.lit("")))


def safe_path(path: Column) -> Column:
    """Whether a name stays inside its folder: relative, no backslash, drive or zero byte, and no step up."""
    return F.coalesce((path != "") & ~path.rlike(r"^/|^[A-Za-z]:|\\|\x00|(^|/)\.\.(/|$)"), F.lit(False))


def unmet_counts(counts: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, n, expected: where the number of rows is not what was expected; one side's missing keys count 0."""
    joined = counts.select(key, "n").join(expected.select(key, "expected"), key, "full_outer")
    return joined.select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected")).where("n <> expected")


def readiness(catalogue: DataFrame, present: DataFrame, name: str, skip: str, local: str, remote: str) -> DataFrame:
    """name, status: Skipped, Ready (Local), Missing Local, Ready (Remote), or Error (neither place is given).

    ``present`` lists the local paths that exist."""
    there = present.select(F.col("path").alias(local), F.lit(True).alias("_there")).distinct()
    status = F.when(F.coalesce(skip, F.lit(False)), "Skipped").when(F.col("_there"), "Ready (Local)").when(F.col(local).isNotNull(), "Missing Local").when(F.col(remote).isNotNull(), "Ready (Remote)").otherwise("Error")
    return catalogue.join(there, local, "left").select(name, status.alias("status"))
