"""The analytical query suite (Q1-Q6) over the graph tables.

Each function takes a :class:`Graph` and returns a DataFrame; nothing is
collected. Ordering ties are broken by the name / id columns so results are
deterministic, and descending orders put NULL last (a hotel without a score
must never rank first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.agg import avg_of, exact_avg, round_dec
from ..functions.broadcast import checked_broadcast
from ..operators.graph import Graph
from ..operators.patterns import hotel_states, segment_states, top_k, with_hotel_name

# Country pairs are bounded by (number of countries)^2.
_VISA_PAIRS_MAX = 100_000


def _visa_free_pairs(g: Graph) -> DataFrame:
    """(user_id, home) for every traveller and every visited country that needs
    no visa from home: a pair absent from NEEDS_VISA counts as visa-free."""
    # Visited countries per traveller as a set (bounded by the number of
    # countries): deduplicated map-side, shuffled once by user_id, and that
    # partitioning serves the join with home and the final distinct.
    visited = (
        g.stayed_at.join(g.hotel_place.select("hotel_id", F.col("country").alias("visited")), "hotel_id")
        .groupBy("user_id")
        .agg(F.collect_set("visited").alias("visited"))
    )
    home = g.from_country.select("user_id", F.col("country").alias("home"))
    needs = checked_broadcast(
        g.needs_visa.select(F.col("from_country").alias("home"), F.col("to_country").alias("visited")),
        _VISA_PAIRS_MAX,
    )
    pairs = visited.join(home, "user_id").select("user_id", "home", F.explode("visited").alias("visited"))
    return pairs.join(needs, ["home", "visited"], "left_anti").select("user_id", "home")


def q1_visa_free_travellers(g: Graph) -> DataFrame:
    """Travellers who stayed in at least one country needing no visa from home."""
    return _visa_free_pairs(g).select("user_id").distinct().agg(F.count(F.lit(1)).alias("TravellerCount"))


def q1_by_home_country(g: Graph) -> DataFrame:
    """Q1 split by home country (a per-group check of the anti join)."""
    return (
        _visa_free_pairs(g).distinct()
        .groupBy("home")
        .agg(F.count(F.lit(1)).alias("TravellerCount"))
        .select(F.col("home").alias("HomeCountry"), "TravellerCount")
    )


def q2_top_business_hotels(g: Graph, traveller_type: str = "Business", k: int = 3) -> DataFrame:
    """Top hotels (by name) on mean overall score among one traveller type."""
    per_hotel = segment_states(g, F.col("type") == traveller_type, ["score_overall"])
    by_name = with_hotel_name(per_hotel, g).groupBy("name").agg(
        F.sum("score_overall_sum").alias("score_overall_sum"), F.sum("score_overall_n").alias("score_overall_n")
    )
    out = by_name.select(F.col("name").alias("hotelName"), avg_of("score_overall").alias("avgRating"))
    return top_k(out, [F.desc_nulls_last("avgRating"), F.asc_nulls_last("hotelName")], k)


def q3_couples_per_hotel(g: Graph, traveller_type: str = "Couple") -> DataFrame:
    """Every hotel name with its number of travellers of one type who stayed
    there; 0 included (OPTIONAL MATCH with the filter inside the optional side)."""
    typed = g.traveller.where(F.col("type") == traveller_type).select("user_id")
    stays = g.stayed_at.join(typed, "user_id", "left_semi").groupBy("hotel_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        g.hotel.select("hotel_id", "name")
        .join(stays, "hotel_id", "left")
        .groupBy("name")
        .agg(F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("CoupleTravellerCount"))
        .select(F.col("name").alias("HotelName"), "CoupleTravellerCount")
        .orderBy(F.asc_nulls_last("HotelName"))
    )


def q4_least_clean(g: Graph, below: float = 8.8, k: int = 3) -> DataFrame:
    """Lowest-k hotels (by node) whose mean cleanliness is below a bound."""
    per_hotel = with_hotel_name(hotel_states(g, ["score_cleanliness"]), g)
    out = (
        per_hotel.withColumn("AverageCleanliness", avg_of("score_cleanliness"))
        .where(F.col("AverageCleanliness") < below)
        .select(F.col("name").alias("HotelName"), "AverageCleanliness", "hotel_id")
    )
    return top_k(out, [F.asc("AverageCleanliness"), F.asc_nulls_last("HotelName"), F.asc("hotel_id")], k).drop("hotel_id")


def q5_best_location_women(g: Graph, gender: str = "Female") -> DataFrame:
    """Hotel(s) with the highest mean location score among one gender; ties kept.

    The maximum is a one-row aggregate joined back (no single-partition window)."""
    per_hotel = with_hotel_name(segment_states(g, F.col("gender") == gender, ["score_location"]), g).select(
        F.col("name").alias("HotelName"), avg_of("score_location").alias("AverageLocationScore")
    )
    best = per_hotel.agg(F.max("AverageLocationScore").alias("AverageLocationScore"))
    return per_hotel.join(F.broadcast(best), "AverageLocationScore").select("HotelName", "AverageLocationScore")


def q6_improvement_rule(g: Graph, traveller_type: str = "Solo", gender: str = "Female") -> DataFrame:
    """Per age group: how far hotel base scores (clean+comfort+facilities) exceed
    the mean review sum, in percent, over hotels where base >= mean."""
    where = (F.col("type") == traveller_type) & (F.col("gender") == gender)
    per = segment_states(g, where, ["base3"], extra_keys=["age"])
    base = g.hotel.select(
        "hotel_id", (F.col("cleanliness_base") + F.col("comfort_base") + F.col("facilities_base")).alias("hotel_base_sum")
    )
    pct = (
        per.join(base, "hotel_id")
        .withColumn("avg_review_score", avg_of("base3"))
        .where(F.col("hotel_base_sum") >= F.col("avg_review_score"))
        .withColumn(
            "improvement_pct",
            F.try_divide(F.lit(100.0) * (F.col("hotel_base_sum") - F.col("avg_review_score")), F.col("avg_review_score")),
        )
    )
    return (
        pct.groupBy(F.col("age").alias("age_group"))
        .agg(
            round_dec(F.min("improvement_pct"), 2).alias("min_improve"),
            round_dec(F.max("improvement_pct"), 2).alias("max_improve"),
            round_dec(exact_avg("improvement_pct"), 2).alias("avg_improve"),
        )
        .orderBy(F.asc_nulls_last("age_group"))
    )
