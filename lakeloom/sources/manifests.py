"""Shard lists from manifests, and line files in their three reading modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Not data, though they lie among it.
MANIFESTS = ("manifest.json", "local_manifest.json")


def shard_names(manifests: DataFrame, dataset: str, train: str, val: str) -> DataFrame:
    """(dataset, split, k, name) of each shard a manifest counts; validation shards are numbered after the others."""
    total = F.coalesce(F.col(train), F.lit(0)) + F.coalesce(F.col(val), F.lit(0))
    rows = manifests.where(total > 0).select(dataset, train, F.explode(F.sequence(F.lit(0), total - 1)).alias("k"))
    split = F.when(F.col("k") < F.coalesce(F.col(train), F.lit(0)), "train").otherwise("val")
    return rows.select(dataset, split.alias("split"), "k", F.format_string("%s-%06d.tar", F.col(dataset), F.col("k")).alias("name"))


#: The names under which manifests count shards, in the order in which a builder of training sets, a
#: loader of training sets, and a loader of validation sets look for them.
BUILDER_COUNTS = ("num_train_shards", "num_shards", "train_shards", "total_shards")
LOADER_COUNTS = ("num_shards", "total_shards", "num_train_shards", "train_shards")
VALIDATION_COUNTS = ("val_shards", "num_val_shards")


def discovered(manifests: DataFrame, files: DataFrame, counts: tuple[str, ...] = BUILDER_COUNTS, validation: bool = False, only_present: bool = True, most: int | None = None) -> DataFrame:
    """(dataset, k, name) of each shard of each dataset, k from 0.

    manifests: dataset, shards (names, or null), the counts, num_train_shards, and configured (shards of the training
    set, or null). Listed names count first; a list without num_train_shards holds validation shards too and is cut to
    those configured. Else a count makes names: ``shard-%06d.tar`` if the first of them is among ``files`` (dataset,
    name), else those of the dataset's own name; validation shards go on where the training shards end. Datasets whose
    manifest says nothing have the files there are, by name. Shards that are no file go, if ``only_present``; then at
    most ``most`` stay."""
    has = lambda c: F.col(c) if c in manifests.columns else F.lit(None).cast("int")
    start = F.coalesce(has("num_train_shards"), has("num_shards"), has("total_shards"), F.lit(0)) if validation else F.lit(0)
    listed = F.when(F.size("shards") > 0, F.col("shards")) if "shards" in manifests.columns else F.lit(None).cast("array<string>")
    if not validation:
        listed = F.when(has("num_train_shards").isNull() & (has("configured") > 0), F.slice(listed, F.lit(1), F.greatest(has("configured"), F.lit(0)))).otherwise(listed)
    m = manifests.select("dataset", listed.alias("_listed"), F.coalesce(*map(has, counts)).alias("_n"), start.cast("int").alias("_start"))
    m = m.withColumn("_first", F.format_string("shard-%06d.tar", "_start")).join(files.select("dataset", F.col("name").alias("_first"), F.lit(True).alias("_generic")).distinct(), ["dataset", "_first"], "left")
    stem = F.when(F.col("_generic"), "shard").otherwise(F.translate("dataset", "_", "-"))
    numbers = F.when(F.col("_n") > 0, F.sequence(F.col("_start"), F.col("_start") + F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))
    counted = F.when(F.col("_n").isNotNull(), F.transform(numbers, lambda k: F.format_string("%s-%06d.tar", stem, k)))
    m = m.withColumn("_names", F.coalesce("_listed", counted))
    named = m.where("_names is not null").select("dataset", F.posexplode("_names").alias("k", "name"))
    own = Window.partitionBy("dataset")
    there = files.select("dataset", "name").distinct()
    silent = there.join(m.where("_names is null").select("dataset"), "dataset", "left_semi").withColumn("k", F.row_number().over(own.orderBy("name")) - 1)
    out = named.unionByName(silent)
    if only_present:
        out = out.join(there, ["dataset", "name"], "left_semi")
    out = out.withColumn("k", F.row_number().over(own.orderBy("k")) - 1)  # the shards of one dataset
    return out.select("dataset", "k", "name") if most is None else out.where(F.col("k") < most).select("dataset", "k", "name")


def staged_samples(shards: DataFrame, samples: str, total: str, count: str) -> DataFrame:
    """shards with ``samples`` filled where a manifest has no number: the set's samples over its shards, one at least."""
    share = F.greatest(F.lit(1), F.floor(F.coalesce(F.col(total), F.lit(0)) / F.greatest(F.coalesce(F.col(count), F.lit(1)), F.lit(1))))
    return shards.withColumn(samples, F.coalesce(F.col(samples).cast("long"), share.cast("long")))


def json_lines(spark: SparkSession, path: str, schema: str | StructType, mode: str = "skip") -> DataFrame:
    """Records of all .json and .jsonl files under ``path`` but manifests, with their file as ``file``.

    mode: skip (broken lines go), keep (broken lines come as nulls with the line in ``broken``), strict (they fail)."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.json*", "mode": {"skip": "DROPMALFORMED", "keep": "PERMISSIVE", "strict": "FAILFAST"}[mode]}
    if mode == "keep":
        fields, options["columnNameOfCorruptRecord"] = StructType([*fields.fields, StructField("broken", StringType())]), "broken"
    rows = spark.read.schema(fields).options(**options).json(path).select("*", F.col("_metadata.file_path").alias("file"))
    return rows.where(~F.element_at(F.split("file", "/"), -1).isin(*MANIFESTS))


def run_logs(spark: SparkSession, root: str, schema: str, name: str = "perf.jsonl") -> DataFrame:
    """Records of all files ``name`` under ``root``, with run_dir: the folder below ``root`` that the file lies in."""
    rows = spark.read.schema(schema).options(recursiveFileLookup="true", pathGlobFilter=name, mode="DROPMALFORMED").json(root)
    inside = F.element_at(F.split(F.col("_metadata.file_path"), F.concat(F.lit(r"\Q"), F.lit("/" + root.split(":")[-1].strip("/")), F.lit(r"/\E"))), -1)
    return rows.select(F.regexp_replace(inside, r"/?[^/]*$", "").alias("run_dir"), "*")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence): the first word of each header and the lines below it, joined, in upper case.

    A record begins at a ``>`` at the start of a line; one elsewhere is part of its line. A record is one row."""
    lines = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")
    record = lines.select(F.regexp_replace("value", r"^>", "").alias("value"))
    head = F.regexp_extract("value", r"^[ \t]*(\S*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")
    return record.select(head.alias("name"), F.upper(body).alias("sequence"))


def sections(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """One row a text file: what stands under each ``=== NAME ===`` line, null where the file has no such line."""
    text = spark.read.text(path, wholetext=True)
    found = [F.when(F.col("value").rlike(rf"(?m)^=== {n} ===$"), F.trim(F.regexp_extract("value", rf"(?sm)^=== {n} ===$\n?(.*?)\n?(?=^=== |\z)", 1))).alias(n.lower().replace(" ", "_")) for n in names]
    return text.select(F.col("_metadata.file_name").alias("file"), *found)
