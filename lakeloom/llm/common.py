"""Shared pieces: scratch tables in the cluster's shared folder, connected components, batch slicing."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by local sessions that name no shared folder, as in tests.
DEFAULT_SHARED = "file:///tmp/checkpoints/lakeloom"
#: Characters of text that a Python task works on at once.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder's path under spark.checkpoint.dir, which a cluster must name: executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = DEFAULT_SHARED
    return f"{base.rstrip('/')}/lakeloom-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop_saved(*dfs: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for df in dfs:
        if path := getattr(df, "_saved_at", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``chars`` bytes of the text column, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        n = np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        piece = (np.cumsum(n) - n) // chars
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            yield b.slice(int(lo), int(hi - lo))


#: Shares that rows of one key are dealt out by.
SALTS = 32


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str | list[str], how: str = "inner", keys: DataFrame | None = None) -> DataFrame:
    """many joined with one on key, where one has a row a key and many may have any number: rows of a key are dealt by a
    hash of ``by``, and the key's row goes to each share that has any. keys: the columns key and by of many, where they
    are cheaper to read than many itself."""
    salt = F.pmod(F.xxhash64(*([by] if isinstance(by, str) else by)), F.lit(SALTS)).cast("int")
    wanted = (many if keys is None else keys).select(key, salt.alias("_salt")).distinct().join(one, key)
    return many.withColumn("_salt", salt).join(wanted, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, label): the smallest node of each connected component, for nodes that have edges.

    Minimum labels travel along edges and then jump to their own label's label, so rounds grow with the
    logarithm of a component's diameter; each round is one aggregation and one join on node ids."""
    both = saved(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).union(edges.select(F.col(dst), F.col(src))).distinct())
    label = saved(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        seen = both.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = saved(spread_join(step, jump, "label", "node", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        moved = not after.where("old <> label").isEmpty()
        drop_saved(label)
        label = after
        if not moved:
            drop_saved(both)
            out = label.select("node", "label")
            out._saved_at = after._saved_at
            return out
