"""Tables in other formats: sniffed CSV, Arrow files, series files, episode chunks, tensors; writers of fixed forms."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that a delimiter is guessed from.
SNIFFED = 8192


def delimited(spark: SparkSession, path: str, dataset: str = "", tab_sets: tuple[str, ...] = ("chebi",)) -> DataFrame:
    """A CSV file with a header, all values text; cut at tabs if the dataset's name holds one of ``tab_sets``."""
    tab = any(x in dataset.lower() for x in tab_sets)
    return spark.read.csv(path, header=True, sep="\t" if tab else ",", multiLine=True, escape='"')


def sniffed(spark: SparkSession, path: str, renamed: dict[str, str] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file whose delimiter is guessed from its first bytes (tab if they do not tell), columns ``renamed``, and
    only rows whose ``required`` columns are not blank. The driver reads those first bytes alone."""
    first = spark.read.format("binaryFile").load(path).select("path").orderBy("path").first()
    head = b""
    if first:
        system, where = fs.FileSystem.from_uri(first.path)
        with system.open_input_stream(where) as stream:
            head = stream.read(SNIFFED)
    try:
        sep = csv.Sniffer().sniff(head.decode("utf-8", "replace"), delimiters=",\t;|").delimiter
    except csv.Error:
        sep = "\t"
    rows = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    for old, new in (renamed or {}).items():
        if old in rows.columns and new not in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    for c in required:
        rows = rows.where(F.trim(F.col(c)) != "")
    return rows


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with a header, all values text and empty ones as such."""
    return spark.read.csv(path, header=True, sep="\t", quote="", nullValue=None, emptyValue="").na.fill("")


def arrow_files(spark: SparkSession, path: str, schema: str | StructType, pattern: str = "*.arrow") -> DataFrame:
    """The rows of Arrow files or streams under ``path``, batch by batch; columns that a file lacks are null. A saved
    dataset's folder is such a path."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(fields)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shaped(b: pa.RecordBatch) -> pa.RecordBatch:
            columns = [b.column(f.name).cast(f.type) if f.name in b.schema.names else pa.nulls(b.num_rows, f.type) for f in wanted]
            return pa.RecordBatch.from_arrays(columns, schema=wanted)

        for b in batches:
            for uri in b.column("path").to_pylist():
                system, where = fs.FileSystem.from_uri(uri)
                with system.open_input_file(where) as source:
                    start = source.read(6)
                    source.seek(0)
                    if start == b"ARROW1":
                        reader = pa.ipc.open_file(source)
                        yield from (shaped(reader.get_batch(k)) for k in range(reader.num_record_batches))
                    else:
                        yield from map(shaped, pa.ipc.open_stream(source))

    return files.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(scan, fields)


def series_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, numbers, texts) of .csv and .npy files: a .csv's values as numbers, or as texts if one of them is the mark X;
    an .npy's as numbers, in order. Files of other kinds or that cannot be read have neither."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            numbers, texts = [], []
            for name, content in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                own = said = None
                try:
                    if name.endswith(".npy"):
                        own = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float64).ravel().tolist()
                    elif name.endswith(".csv"):
                        cells = [c.strip() for row in csv.reader(io.StringIO(content.decode("utf-8-sig"))) for c in row if c.strip()]
                        if "X" in cells:
                            said = cells
                        else:
                            own = [float(c) for c in cells]
                except (ValueError, UnicodeDecodeError, EOFError):
                    pass
                numbers.append(own)
                texts.append(said)
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(numbers, pa.list_(pa.float64())), pa.array(texts, pa.list_(pa.string()))], ["file", "numbers", "texts"])

    return files.mapInArrow(parse, "file string, numbers array<double>, texts array<string>")


def episode_chunks(spark: SparkSession, root: str, columns: list[str], chunks: int = 20) -> DataFrame:
    """The named columns of the Parquet files in ``root``/chunk-NNN/episode_NNNNNN.parquet, with episode; chunks up to
    ``chunks`` only. What is not asked for is not read."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "episode_*.parquet").parquet(root)
    path = F.col("_metadata.file_path")
    episode = F.regexp_extract(path, r"episode_(\d+)\.parquet$", 1).cast("long")
    return files.select(episode.alias("episode"), *columns).where(F.floor(F.col("episode") / 1000) <= chunks)


def train_files(spark: SparkSession, root: str, banned: tuple[str, ...] = ("test", "validation"), limit: int | None = None) -> DataFrame:
    """The rows of Parquet files under ``root`` whose names hold none of the ``banned`` words; with ``limit`` the first so
    many, files by name."""
    rows = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(root)
    name = F.lower(F.col("_metadata.file_name"))
    kept = rows.where(~F.coalesce(*(F.when(F.contains(name, F.lit(b)), True) for b in banned), F.lit(False)))
    return kept if limit is None else kept.orderBy("_metadata.file_path", "_metadata.row_index").limit(limit)


def tensor_problem(payload: Column, kind: Column, shape: Column) -> Column:
    """What is wrong with a base64 tensor: dtype, shape, base64, size; null if nothing is."""
    width = F.when(kind == "f32", 4).when(kind.isin("f16", "bf16"), 2)
    cells = F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)
    raw = F.try_to_binary(payload, F.lit("base64"))
    return F.when(width.isNull(), "dtype").when((F.size(shape) < 1) | F.exists(shape, lambda x: x.isNull() | (x <= 0)), "shape").when(raw.isNull(), "base64").when(F.octet_length(raw) != cells * width, "size")


def decoded_tensors(df: DataFrame, payload: str, kind: str, shape: str, name: str = "values") -> DataFrame:
    """Adds ``name``, the numbers of a base64 tensor in order, and ``problem``; numbers only where there is none."""

    @F.pandas_udf("array<float>")
    def numbers(raw, kinds):
        import numpy as np
        import pandas as pd

        def one(x, k):
            if x is None:
                return None
            if k == "bf16":
                return (np.frombuffer(x, dtype="<u2").astype("<u4") << 16).view("<f4")
            return np.frombuffer(x, dtype="<f4" if k == "f32" else "<f2").astype("<f4")

        return pd.Series([one(x, k) for x, k in zip(raw, kinds, strict=True)])

    df = df.withColumn("problem", tensor_problem(F.col(payload), F.col(kind), F.col(shape)))
    raw = F.when(F.col("problem").isNull(), F.try_to_binary(F.col(payload), F.lit("base64")))
    return df.withColumn(name, numbers(raw, F.col(kind)))


# ---- writers -----------------------------------------------------------------------------------------------------


def fixed_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as text in this order; what is missing or null is empty."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))


def write_delimited(df: DataFrame, path: str, columns: list[str], sep: str = "\t", order: str | None = None) -> None:
    """fixed_columns() as a folder of delimited files with headers, rows in order over all files if one is named."""
    rows = fixed_columns(df.orderBy(order) if order else df, columns)
    rows.write.mode("overwrite").csv(path, header=True, sep=sep, emptyValue="", escape='"')


def union_schema(*frames: DataFrame, first: str) -> DataFrame:
    """All rows under the columns of all frames, ``first`` before the others in the order they are met."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(first, *(c for c in out.columns if c != first))


def missing_chunks(chunks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Chunks that no earlier run has written whole: those without a row count above 0 in ``done`` (key, rows)."""
    return chunks.join(done.where("rows > 0").select(key), key, "left_anti")


def write_chunks(rows: DataFrame, path: str, chunk: str) -> DataFrame:
    """Writes the chunks of ``rows`` that ``path`` does not hold yet, a folder each; returns (chunk, rows) of all there is."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[chunk]

    def held() -> DataFrame:
        try:
            return spark.read.parquet(path).groupBy(F.col(chunk).cast(kind).alias(chunk)).agg(F.count(F.lit(1)).alias("rows"))
        except Exception as e:  # no earlier run
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return spark.createDataFrame([], f"{chunk} {kind}, rows long")

    new = rows.join(held().where("rows > 0").select(chunk), chunk, "left_anti")
    new.repartition(chunk).write.mode("append").partitionBy(chunk).parquet(path)
    return held()


def lines_manifest(df: DataFrame, columns: list[str], order: str, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, fingerprint): rows as JSON lines in order, and one row with their number and a SHA-256 of the set of
    lines, to refuse another manifest under the same name."""
    from lakeloom.operators.audit import fingerprint

    lines = df.select(F.col(order).alias("_o"), F.to_json(F.struct(*columns)).alias("value"))
    return lines.orderBy("_o").select("value"), fingerprint(lines, ["value"], digits)


def is_converted(manifest: DataFrame, dataset: str, expected: int, sampled: bool = False) -> bool:
    """Whether a dataset's manifest (dataset, shards) lists as many shards as expected; never for a run over a sample."""
    if sampled:
        return False
    row = manifest.where(F.col("dataset") == dataset).agg(F.max("shards").alias("n")).first()
    return row.n is not None and row.n >= expected
