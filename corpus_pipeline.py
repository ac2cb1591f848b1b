"""A corpus pipeline of four operators: quality, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir); docs are what the stage before has kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.byte_bpe import bpe_encode
from lakeloom.llm.common import saved, table
from lakeloom.llm.mixing import mixed_documents
from lakeloom.llm.near_dedup import without_near_duplicates
from lakeloom.llm.quality_crf import score_quality
from lakeloom.llm.queries import quality_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from the labels outside the held-out fold.

    A null or empty text is scored as one empty line; rows that repeat get one decision; without labelled texts every
    score is 0.5 and all stay; an empty table gives an empty one. Only the text decides."""
    model = quality_model(spark, sf_dir, table(spark, sf_dir, "documents"))
    return score_quality(docs, model).where("score >= 0.5").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8 or more), that with the smallest id.
    Rows of one id with unlike texts are no duplicates; rows without words or with a null id stay."""
    return without_near_duplicates(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, twice at most.

    Null sources are a source, null ids count as one id, rows with the same id and size are taken in part where only some
    fit; texts without words (null and empty ones too) are taken never; an empty table gives an empty one."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row's ids and of what they decode to: doc_id, n_tokens, ids_sha256 and
    decoded_sha256. A null or empty text has no ids; null ids and repeated rows stay; an empty table gives an empty one."""
    out = bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("tokens", tokens),
]

#: The trained classifier and the byte-level merges are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
