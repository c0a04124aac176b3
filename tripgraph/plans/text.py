"""Text documents, samples and the vector store (X1-X4, X10, S8-S10).

Review documents: ``Hotel: <name>. Review: <text>`` (a missing value prints
``nan``). Feature documents, one per review:
``Hotel: <name> (ID: <id>). Cleanliness: c, Comfort: c, Facilities: f,
Location: l, Staff: s, Value for Money: v.`` with missing scores 0.0 and a
missing name ``Unknown Hotel``. Built with native string functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import path_exists

# Feature sentence labels and the score columns they print, in order.
FEATURE_FIELDS = [
    ("Cleanliness", "score_cleanliness"),
    ("Comfort", "score_comfort"),
    ("Facilities", "score_facilities"),
    ("Location", "score_location"),
    ("Staff", "score_staff"),
    ("Value for Money", "score_value_for_money"),
]
UNKNOWN_HOTEL = "Unknown Hotel"
MISSING_TEXT = "nan"

SAMPLE_SEED = 42


def _s(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def _named_reviews(reviews: DataFrame, hotels: DataFrame) -> DataFrame:
    """Reviews left-joined to hotel names (every review kept)."""
    return reviews.join(hotels.select("hotel_id", "hotel_name"), "hotel_id", "left")


def review_docs(reviews: DataFrame, hotels: DataFrame) -> DataFrame:
    """(review_id, hotel_id, text)."""
    text = F.concat(
        F.lit("Hotel: "), F.coalesce(_s("hotel_name"), F.lit(MISSING_TEXT)),
        F.lit(". Review: "), F.coalesce(_s("review_text"), F.lit(MISSING_TEXT)),
    )
    return _named_reviews(reviews, hotels).select("review_id", "hotel_id", text.alias("text"))


def feature_docs(reviews: DataFrame, hotels: DataFrame) -> DataFrame:
    """(review_id, hotel_id, text): one hotel-feature sentence per review."""
    parts = [F.lit("Hotel: "), F.coalesce(F.col("hotel_name"), F.lit(UNKNOWN_HOTEL)),
             F.lit(" (ID: "), F.coalesce(_s("hotel_id"), F.lit(MISSING_TEXT)), F.lit("). ")]
    for i, (label, col) in enumerate(FEATURE_FIELDS):
        parts += [F.lit(f"{label}: "), _s(F.coalesce(F.col(col), F.lit(0.0)))]
        parts.append(F.lit(", " if i < len(FEATURE_FIELDS) - 1 else "."))
    return _named_reviews(reviews, hotels).select("review_id", "hotel_id", F.concat(*parts).alias("text"))


def doc_sample(docs: DataFrame, n: int, id_col: str = "review_id", seed: int = SAMPLE_SEED) -> DataFrame:
    """Reproducible sample of ``n`` rows without replacement: the n smallest
    md5 digests of seed and id (ties by id, then text). Planned as a global
    top-k, not a sort. Raises when fewer than n rows exist, as a sample of n must."""
    if docs.limit(n).count() < n:
        raise ValueError(f"cannot sample {n} rows from fewer")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    return docs.orderBy(digest, F.col(id_col), F.col("text")).limit(n)


# ----------------------------------------------------------------------------- vector store
def write_vectors(vectors: DataFrame, path: str, model: str) -> None:
    """Replace one model's vectors (dynamic partition overwrite keeps the others).
    ``vectors``: (doc_id, hotel_id, text, embedding)."""
    (vectors.withColumn("model", F.lit(model)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path))


def read_vectors(spark: SparkSession, path: str, model: str) -> DataFrame | None:
    """Open one model's vectors by its short name (the part before a space);
    None when the store or the model is absent."""
    if not path_exists(spark, path):
        return None
    out = spark.read.parquet(path).where(F.col("model") == model.split(" ")[0])
    return out if out.limit(1).count() else None
