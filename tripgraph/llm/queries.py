"""One registered query per training-data operator: each applies its operator
with production parameters to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (embed_graph, filter_audit, html_density, line_dedup, merkle, minhash, oracles, quality_rff, secret_forest, sp_trie, token_count,
               toxicity_zstd, warc_chunks, winnowing)
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document; the value itself only as a digest."""
    found = secret_forest.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "finding_no", "start", F.length("value").cast("bigint").alias("n_chars"),
                        F.sha2("value", 256).alias("value_sha256"), "score", "secret")


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.archive_round_trip(read_table(spark, sf_dir, "pages"))


def op3_html_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_main_text(read_table(spark, sf_dir, "pages"))


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_zstd.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text: the digest
    of the decoded text beside that of the text itself."""
    docs = read_table(spark, sf_dir, "documents")
    return sp_trie.encode_documents(docs).select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_pieces"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rff.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), per_cent=85).drop("text_hash")


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_graph.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = winnowing.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_audit(read_table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """For the operators that SQL can express; tests hold the others against
    brute force, exact round trips or held-out accuracy."""
    return {
        "op2_warc_chunks": oracles.archive(),
        "op7_minhash_near_dedup": oracles.near_dedup(85),
        "op9_embedding_near_dedup": oracles.near_vectors(0.95),
        "op10_benchmark_decontamination": oracles.contamination(),
        "op11_filter_interaction_audit": oracles.filter_audit(),
        "op12_merkle_manifest": oracles.manifest(),
        "op13_line_dedup": oracles.line_dedup(),
    }
