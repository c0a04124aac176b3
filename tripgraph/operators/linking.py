"""Entity dictionary and case-insensitive substring linking.

Linking finds, per question and category, the longest dictionary value whose
lower-case form occurs in the lower-cased question (ties: smallest value).
Every value is filed under one of its trigrams, the one that fewest values
have; values of one or two characters are their own key. Every distinct
question text is cut into its distinct trigrams (and shorter grams, if there
are such values), which are joined to the keys on equality; the pairs that meet
are verified by a substring test. A text gives at most as many rows as it has
characters, whatever the dictionary's value lengths. A key of many values is
split into parts of bounded size, and only texts with that key are repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.broadcast import checked_broadcast
from ..functions.text import AGE_CATEGORY, written
from .graph import Graph
from .patterns import top_k_per

# Characters of a key, and values that one part of a key holds on average, at most.
GRAM, PART_VALUES = 3, 1000


def entity_dictionary(g: Graph) -> DataFrame:
    """(category, value): city, country and hotel names, traveller types, genders
    and age groups; NULL and empty values dropped."""
    t = g.traveller
    parts = [
        g.city.select(F.lit("City").alias("category"), F.col("name").alias("value")),
        g.country.select(F.lit("Country").alias("category"), F.col("name").alias("value")),
        g.hotel.select(F.lit("Hotel").alias("category"), F.col("name").alias("value")),
        t.select(F.lit("Traveller Type").alias("category"), F.col("type").alias("value")),
        t.select(F.lit("Gender").alias("category"), F.col("gender").alias("value")),
        t.select(F.lit(AGE_CATEGORY).alias("category"), F.col("age").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def _grams(text: str, n: int) -> Column:
    """The ``n``-character substrings of a text; none if it is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.col(text).substr(i, F.lit(n)))


def _keyed_values(values: DataFrame) -> DataFrame:
    """``values`` (category, value, v_lc, v_len) with ``gram``, the rarest one of
    each value, and ``part``: values of one gram in parts of ``PART_VALUES``."""
    size = F.least(F.length("v_lc"), F.lit(GRAM))
    each = values.select("v_lc").distinct().withColumn("gram", F.explode(F.array_distinct(
        F.when(size == GRAM, _grams("v_lc", GRAM)).otherwise(F.array("v_lc")))))
    rarity = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    key = each.join(rarity, "gram").groupBy("v_lc").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    keyed = values.join(key, "v_lc")
    many = keyed.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / PART_VALUES).cast("int").alias("parts"))
    return keyed.join(many, "gram").select("category", "value", "v_lc", "v_len", "gram", F.pmod(F.xxhash64("value", "category"), F.col("parts")).cast("int").alias("part"))


def link_entities(questions: DataFrame, dictionary: DataFrame, text_col: str = "user_query") -> DataFrame:
    """(question_id, category, value) for the best match of each category."""
    # Written: keys, their counts and the values are all made from it.
    dictionary = written(dictionary, "entity_dictionary")
    d = (
        dictionary.where(F.col("category") != AGE_CATEGORY)
        .select("category", "value", F.lower("value").alias("v_lc"), F.length("value").alias("v_len"))
        .where(F.length("v_lc") > 0)
    )
    keyed = written(_keyed_values(d), "entity_keys")
    sizes = sorted(r[0] for r in keyed.select(F.length("gram")).distinct().collect())  # of 1, 2 and 3
    if not sizes:
        return questions.sparkSession.createDataFrame([], "question_id bigint, category string, value string")
    q = questions.select("question_id", F.lower(F.col(text_col)).alias("q_lc")).where(F.col("q_lc").isNotNull())
    # Links depend only on the text: link each distinct text once.
    texts = q.select("q_lc").distinct()
    grams = texts.select("q_lc", F.explode(F.array_distinct(F.flatten(F.array(*[_grams("q_lc", n) for n in sizes])))).alias("gram"))
    parts = keyed.groupBy("gram").agg((F.max("part") + 1).alias("parts"))
    asked = grams.join(checked_broadcast(parts), "gram").select("q_lc", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    cand = asked.join(checked_broadcast(keyed), ["gram", "part"]).where(F.contains("q_lc", "v_lc"))
    best = top_k_per(cand, ["q_lc", "category"], [F.desc("v_len"), F.asc("value")], 1, "_rk").select(
        "q_lc", "category", "value")
    # Back to questions; a text shared by a third of all questions is a hot key
    # on the question side only (AQE splits it). ``best`` is not counted up front
    # (that would run the whole linking twice): AQE turns the join into a
    # broadcast from the measured size of its shuffle, when that is small.
    return q.join(best, "q_lc").select("question_id", "category", "value")
