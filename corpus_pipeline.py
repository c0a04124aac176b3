"""Corpus pipeline: five stages over ``documents``, each one of the
training-data operators on all that its predecessor kept.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame with
the columns of ``docs`` (the last adds its own); ``run`` writes each result as
Parquet and reads it again as the next one's input. Rows with null or repeated
ids and null texts are carried as each stage's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripgraph.functions.broadcast import checked_broadcast
from tripgraph.llm import minhash, quality_rff, secret_forest, sp_trie, winnowing
from tripgraph.llm.common import packed, read_table, unpacked, written

# Similarity from which documents count as copies of each other, in per cent.
NEAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts (score of at least 0.7). The
    score depends on the text alone, so repeated rows share their fate; with no
    usable labels nothing is learnt and every row stays."""
    features = quality_rff.document_features(docs)
    model = quality_rff.fit_quality(features, read_table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    return docs.where(quality_rff.quality_score(model) >= quality_rff.THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id; of
    rows that repeat an id and text, one. Rows with a null id have no copies,
    nor have texts without words: all of them stay, but repeats of an id."""
    found = written(minhash.near_duplicates(docs, NEAR), "near_duplicates").where("doc_id IS NOT NULL")
    per_row = found.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    # Only rows that go or repeat are named, so most rows pass without a match.
    named = checked_broadcast(written(per_row.where("NOT stays OR n > 1"), "named_duplicates"), minhash.BROADCAST_IDS)
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    marked = rows.join(named, ["doc_id", "text_hash"], "left")
    once = marked.where("n IS NULL")
    again = marked.where("stays").dropDuplicates(["doc_id", "text_hash"])
    return once.unionByName(again).select(*unpacked(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a word inside a benchmark passage, judged by their text
    alone; null and empty texts have no words and stay."""
    return winnowing.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret that the forest finds replaced in the text."""
    trees, words, _ = secret_forest.train(docs)
    return secret_forest.redact(docs, trees, words)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces, decoded_sha256) of every row: its piece ids and
    the digest of the text that they decode to, which is the row's text. A null
    text has no ids and decodes to the empty text."""
    return sp_trie.encode_documents(docs).select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_pieces"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", encode),
]

# The classifier, the forest and the pieces cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage_{k + 1}")
    return docs
