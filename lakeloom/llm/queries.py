"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.byte_bpe import bpe_encode
from lakeloom.llm.centroid_clusters import CLUSTER_SQL, centroid_clusters
from lakeloom.llm.common import table
from lakeloom.llm.exact_topk import TOPK_SQL, exact_topk
from lakeloom.llm.fill_in_middle import FIM_SQL, fill_in_middle
from lakeloom.llm.html_text import extract_text
from lakeloom.llm.license_scan import license_sql, scan_licenses
from lakeloom.llm.media import read_media, store_media
from lakeloom.llm.mixing import MIX_SQL, mix_sources
from lakeloom.llm.near_dedup import near_duplicates, near_duplicates_sql
from lakeloom.llm.piece_bpe import piece_encode
from lakeloom.llm.quality_crf import QualityModel, score_quality, train_quality
from lakeloom.llm.token_files import token_table
from lakeloom.llm.warc import WARC_SQL, warc_round_trip


def held_out(id_col: str = "doc_id"):
    """Whether a document is in the fold that no model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> QualityModel:
    return train_quality(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, quality_model(spark, sf_dir, docs), keep=["doc_id"])
    return scored.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op4_ranked_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, whole=False)


def op5_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_branch_and_bound_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op7_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_media(store_media(table(spark, sf_dir, "documents"), keep=["doc_id"]), pixels=False)
    return out.select("row.doc_id", *(c for c in out.columns if c != "row"))


def op8_two_tier_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_boosted_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("row.page_id", "row.url", "text", "n_chars")


def op10_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"], texts=False)
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], decode=True)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("row.doc_id", "n_tokens", digest(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_crf_quality, op2_minhash_near_dedup, op3_template_licenses, op4_ranked_token_files, op5_pareto_mixing, op6_branch_and_bound_topk, op7_lossless_webp, op8_two_tier_byte_bpe, op9_boosted_html_text, op10_chunked_warc, op11_annulus_clusters, op12_fill_in_middle, op13_prefix_table_pieces)}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": near_duplicates_sql(), "op3_template_licenses": license_sql(), "op5_pareto_mixing": MIX_SQL, "op6_branch_and_bound_topk": TOPK_SQL, "op10_chunked_warc": WARC_SQL, "op11_annulus_clusters": CLUSTER_SQL, "op12_fill_in_middle": FIM_SQL}
