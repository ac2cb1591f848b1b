"""Scratch tables in the folder that a cluster's machines share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by local sessions that name no shared folder, as in tests.
DEFAULT_SHARED = "file:///tmp/checkpoints/lakeloom"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder's path under spark.checkpoint.dir, which a cluster must name: its machines share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = DEFAULT_SHARED
    return f"{base.rstrip('/')}/lakeloom-{uuid.uuid4().hex}"


class Scratch:
    """Tables written and read again, so that lineage ends with them; ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def saved(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
