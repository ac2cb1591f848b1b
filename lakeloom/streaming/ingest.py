"""Incremental, idempotent ingestion: a file stream whose batches are upserted into a table of latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_latest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: list[str], version: str, buckets: int = 64, file_format: str = "json") -> StreamingQuery:
    """Reads what has newly come to ``source`` and keeps for each key the row with the largest ``version`` in ``target``;
    of equal versions the row whose columns come last as JSON.

    Rows are bucketed by a hash of their key, and a batch rewrites only the buckets that it touches, each under a folder of
    its batch; a batch that runs twice writes the same rows to the same folder. Choose ``buckets`` so that one is some GB,
    and keep to it. Folders that the batch before has superseded are deleted, so that two versions of a bucket are kept at
    most: the one that is read and the one that a rerun would begin from. ``current`` reads the table."""
    stream = spark.readStream.schema(schema).format(file_format).load(source)

    def upsert(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = {r.bucket for r in rows.select("bucket").distinct().collect()}  # at most ``buckets``
        if not touched:
            return
        live = _newest(spark, target, number)
        old = _read(spark, target, schema, {b: n for b, n in live.items() if b in touched})
        both = rows if old is None else rows.unionByName(old)
        columns = [c for c in both.columns if c not in ("bucket", *key)]
        whole = F.struct(*columns)
        latest = both.groupBy("bucket", *key).agg(F.max_by(whole, F.struct(F.col(version), F.to_json(whole))).alias("row")).select("bucket", *key, "row.*")
        latest.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(target)
        for n, b in _folders(spark, target):
            if n < live.get(b, -1):
                _path(spark, f"{target}/batch={n}/bucket={b}", delete=True)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str, delete: bool = False) -> list[str]:
    """The names in a folder (none, if it is not there), or the folder deleted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return []
    if delete:
        system.delete(hadoop, True)
        return []
    return [s.getPath().getName() for s in system.listStatus(hadoop)]


def _folders(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """(batch, bucket) of the folders of a table: a name each, no rows."""
    batches = [int(n[6:]) for n in _path(spark, target) if n.startswith("batch=")]
    return [(n, int(b[7:])) for n in batches for b in _path(spark, f"{target}/batch={n}") if b.startswith("bucket=")]


def _newest(spark: SparkSession, target: str, before: int | None) -> dict[int, int]:
    """The newest batch of each bucket, of those before a batch."""
    out: dict[int, int] = {}
    for n, b in _folders(spark, target):
        if before is None or n < before:
            out[b] = max(n, out.get(b, -1))
    return out


def _read(spark: SparkSession, target: str, schema: str, newest: dict[int, int]) -> DataFrame | None:
    if not newest:
        return None
    paths = [f"{target}/batch={n}/bucket={b}" for b, n in sorted(newest.items())]
    return spark.read.schema(f"{schema}, batch int, bucket int").option("basePath", target).parquet(*paths).drop("batch")


def current(spark: SparkSession, target: str, schema: str, before: int | None = None) -> DataFrame | None:
    """The latest rows of ``target``: of each bucket the newest batch (older than ``before``); None while it is empty.
    Folders are listed; of older ones nothing is read."""
    return _read(spark, target, schema, _newest(spark, target, before))
