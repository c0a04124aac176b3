"""Retrieval queries R1-R11.

Two forms of each:

* scalar, ``fn(g, value)``: the answer for one parameter value (what a single
  question asks), a global top-k;
* per value, ``fn_all(g, ...)``: the answer for *every* parameter value at once,
  ``(key, pos, ...)`` with ``pos <= k``. A result depends only on its parameter
  value, so a batch of questions joins this small table instead of scanning
  the graph once per question.

Keys of case-insensitive parameters are lower-cased (``toLower(a) = toLower($p)``).
Ranking: score descending with NULL last, then name, then id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.agg import avg_of, merge_sum_count, round_dec
from ..operators.graph import Graph
from ..operators.patterns import hotel_states, merge_by, top_k, top_k_per, with_hotel_name, with_place

# The four sort dimensions, their score column, their context label,
# their display label and their empty-result message.
DIMENSIONS = {
    "Cleanliness": ("score_cleanliness", "Cleanest", "Cleanliness", "No cleanliness data found {scope}."),
    "Value": ("score_value_for_money", "Best Value", "Value Score", "No value data found."),
    "Location": ("score_location", "Best Located", "Location Score", "No location data found."),
    "Comfort": ("score_comfort", "Most Comfortable", "Comfort Score", "No comfort data found."),
}

HOTELS_K = 5
GROUPS_K = 3


def _desc(c: str) -> Column:
    return F.desc_nulls_last(c)


# ---------------------------------------------------------------- R1, R2
def _hotel_scores(g: Graph) -> DataFrame:
    return g.hotel.select("hotel_id", F.col("name").alias("Hotel"), F.col("average_reviews_score").alias("Score"))


def hotels_by_city_all(g: Graph, k: int = HOTELS_K) -> DataFrame:
    rows = g.hotel_in_city.select("hotel_id", F.lower("city").alias("city_key")).join(_hotel_scores(g), "hotel_id")
    return top_k_per(rows, ["city_key"], [_desc("Score"), F.asc_nulls_last("Hotel"), F.asc("hotel_id")], k, "pos").select(
        "city_key", "pos", "Hotel", "Score")


def hotels_by_country_all(g: Graph, k: int = HOTELS_K) -> DataFrame:
    rows = g.hotel_place.select("hotel_id", F.lower("country").alias("country_key")).join(_hotel_scores(g), "hotel_id")
    return top_k_per(rows, ["country_key"], [_desc("Score"), F.asc_nulls_last("Hotel"), F.asc("hotel_id")], k, "pos").select(
        "country_key", "pos", "Hotel", "Score")


def hotels_by_city(g: Graph, city: str, k: int = HOTELS_K) -> DataFrame:
    return hotels_by_city_all(g, k).where(F.col("city_key") == F.lower(F.lit(city))).orderBy("pos").select("Hotel", "Score")


def hotels_by_country(g: Graph, country: str, k: int = HOTELS_K) -> DataFrame:
    return hotels_by_country_all(g, k).where(F.col("country_key") == F.lower(F.lit(country))).orderBy("pos").select(
        "Hotel", "Score")


# ---------------------------------------------------------------- traveller segments
def _segment_by(g: Graph, key_expr: Column, key: str, metrics: list[str]) -> DataFrame:
    """Per (segment key, hotel) states; rows with a NULL key are dropped."""
    aggs = [F.sum("paths").alias("paths")] + [c for m in metrics for c in merge_sum_count(m)]
    return g.segment_stats.withColumn(key, key_expr).where(F.col(key).isNotNull()).groupBy(key, "hotel_id").agg(*aggs)


def _rank_avg(df: DataFrame, key: str, label: str, metric: str, out_label: str, out_score: str, k: int,
              require_values: bool = False) -> DataFrame:
    """Mean of ``metric`` per (key, label), top-k per key. ``require_values``
    drops labels without any non-NULL value (a ``WHERE score IS NOT NULL``);
    otherwise they stay with a NULL mean, ranked last."""
    merged = merge_by(df, [key, label], [metric])
    if require_values:
        merged = merged.where(F.col(f"{metric}_n") > 0)
    scored = merged.select(key, F.col(label).alias(out_label), avg_of(metric).alias(out_score))
    return top_k_per(scored, [key], [_desc(out_score), F.asc_nulls_last(out_label)], k, "pos").select(
        key, "pos", out_label, out_score)


def _rank_paths(df: DataFrame, key: str, label: str, out_label: str, k: int) -> DataFrame:
    counted = df.groupBy(key, label).agg(F.sum("paths").alias("Visits"))
    return top_k_per(counted.withColumnRenamed(label, out_label), [key], [_desc("Visits"), F.asc_nulls_last(out_label)],
                     k, "pos").select(key, "pos", out_label, "Visits")


def hotels_by_type_all(g: Graph, k: int = GROUPS_K) -> DataFrame:
    per = with_hotel_name(_segment_by(g, F.lower("type"), "type_key", ["score_overall"]), g)
    return _rank_avg(per, "type_key", "name", "score_overall", "hotelName", "avgRating", k)


def countries_by_type_all(g: Graph, k: int = GROUPS_K) -> DataFrame:
    per = with_place(_segment_by(g, F.lower("type"), "type_key", ["score_overall"]), g)
    return _rank_avg(per, "type_key", "country", "score_overall", "Country", "avgRating", k)


def countries_by_gender_all(g: Graph, k: int = GROUPS_K) -> DataFrame:
    per = with_place(_segment_by(g, F.lower("gender"), "gender_key", []), g)
    return _rank_paths(per, "gender_key", "country", "Country", k)


def _by_groups(g: Graph, requests: DataFrame, metrics: list[str]) -> DataFrame:
    """Per (groups_key, hotel) states for age-group lists: ``requests`` holds
    (groups_key, age) rows, one per member group of each requested list."""
    aggs = [F.sum("paths").alias("paths")] + [c for m in metrics for c in merge_sum_count(m)]
    return g.segment_stats.join(F.broadcast(requests.distinct()), "age").groupBy("groups_key", "hotel_id").agg(*aggs)


def countries_by_age_all(g: Graph, requests: DataFrame, k: int = GROUPS_K) -> DataFrame:
    return _rank_paths(with_place(_by_groups(g, requests, []), g), "groups_key", "country", "Country", k)


def hotels_by_age_all(g: Graph, requests: DataFrame, k: int = GROUPS_K) -> DataFrame:
    per = with_hotel_name(_by_groups(g, requests, ["score_overall"]), g)
    return _rank_avg(per, "groups_key", "name", "score_overall", "Hotel", "avgRating", k)


def hotels_by_traveller_type(g: Graph, traveller_type: str, k: int = GROUPS_K) -> DataFrame:
    return hotels_by_type_all(g, k).where(F.col("type_key") == F.lower(F.lit(traveller_type))).orderBy("pos").select(
        "hotelName", "avgRating")


def best_countries_by_traveller_type(g: Graph, traveller_type: str, k: int = GROUPS_K) -> DataFrame:
    return countries_by_type_all(g, k).where(F.col("type_key") == F.lower(F.lit(traveller_type))).orderBy("pos").select(
        "Country", "avgRating")


def top_countries_by_gender(g: Graph, gender: str, k: int = GROUPS_K) -> DataFrame:
    return countries_by_gender_all(g, k).where(F.col("gender_key") == F.lower(F.lit(gender))).orderBy("pos").select(
        "Country", "Visits")


def _one_request(g: Graph, groups: list[str]) -> DataFrame:
    spark = g.hotel.sparkSession
    key = ",".join(groups)
    return spark.createDataFrame([(key, a) for a in groups], "groups_key string, age string")


def top_countries_by_age_groups(g: Graph, groups: list[str], k: int = GROUPS_K) -> DataFrame:
    return countries_by_age_all(g, _one_request(g, groups), k).orderBy("pos").select("Country", "Visits")


def top_hotels_by_age_groups(g: Graph, groups: list[str], k: int = GROUPS_K) -> DataFrame:
    return hotels_by_age_all(g, _one_request(g, groups), k).orderBy("pos").select("Hotel", "avgRating")


# ---------------------------------------------------------------- R8-R11
def best_hotels_of(g: Graph, scope: str, k: int = HOTELS_K) -> DataFrame:
    """(sort_by, scope_key, pos, Hotel, AvgScore): best hotels by the mean of
    each review score, for every value of a scope, from one aggregate that
    carries all four scores.

    scope: ``global`` (key NULL), ``city`` or ``country``. Hotels whose reviews
    carry no value of a score are left out of it (``WHERE r.score IS NOT NULL``)."""
    metrics = [v[0] for v in DIMENSIONS.values()]
    per = hotel_states(g, metrics)
    if scope == "global":
        per = per.withColumn("scope_key", F.lit(None).cast("string"))
    elif scope == "city":
        per = per.join(g.hotel_in_city, "hotel_id").withColumn("scope_key", F.lower("city"))
    elif scope == "country":
        per = per.join(g.hotel_place, "hotel_id").withColumn("scope_key", F.lower("country"))
    else:
        raise ValueError(scope)
    per = merge_by(with_hotel_name(per, g), ["scope_key", "name"], metrics)
    each = F.explode(F.array(*[
        F.struct(F.lit(dim).alias("sort_by"), F.col(f"{v[0]}_n").alias("n"), avg_of(v[0]).alias("AvgScore")) for dim, v in DIMENSIONS.items()]))
    rows = per.select("scope_key", F.col("name").alias("Hotel"), each.alias("m")).select("scope_key", "Hotel", "m.*").where("n > 0")
    ranked = top_k_per(rows, ["sort_by", "scope_key"], [_desc("AvgScore"), F.asc_nulls_last("Hotel")], k, "pos")
    return ranked.select("sort_by", "scope_key", "pos", "Hotel", "AvgScore")


def best_hotels_all(g: Graph, dim: str, scope: str, k: int = HOTELS_K) -> DataFrame:
    """Best hotels by one review score, for every scope value."""
    if dim not in DIMENSIONS:
        raise ValueError(dim)
    return best_hotels_of(g, scope, k).where(F.col("sort_by") == dim).drop("sort_by")


def best_hotels(g: Graph, dim: str, city: str | None = None, country: str | None = None, k: int = HOTELS_K) -> DataFrame:
    """Scalar form; a city wins over a country."""
    if city:
        out = best_hotels_all(g, dim, "city", k).where(F.col("scope_key") == F.lower(F.lit(city)))
    elif country:
        out = best_hotels_all(g, dim, "country", k).where(F.col("scope_key") == F.lower(F.lit(country)))
    else:
        out = best_hotels_all(g, dim, "global", k)
    return out.orderBy("pos").select("Hotel", "AvgScore")


def best_hotel_answers(g: Graph, requests: DataFrame, k: int = HOTELS_K) -> DataFrame:
    """(request_id, pos, line): what a request for the best hotels is answered.
    ``requests``: (request_id, sort_by, city, country); a city wins over a
    country, without either all hotels are asked for. A request that finds
    nothing gets one row, the dimension's message with the scope's name."""
    scope = F.when(F.col("city").isNotNull(), "city").when(F.col("country").isNotNull(), "country").otherwise("global")
    place = F.coalesce("city", "country")
    asked = requests.where(F.col("sort_by").isin(list(DIMENSIONS))).select(
        "request_id", "sort_by", scope.alias("scope"), F.coalesce(F.lower(place), F.lit("")).alias("key"),
        F.coalesce(F.concat(F.lit("in "), place), F.lit("Globally")).alias("where"))
    best = None
    for name in ("global", "city", "country"):
        part = best_hotels_of(g, name, k).select("sort_by", F.lit(name).alias("scope"), F.coalesce("scope_key", F.lit("")).alias("key"), "pos", "Hotel", "AvgScore")
        best = part if best is None else best.unionByName(part)
    label, message = (F.create_map(*[x for dim, v in DIMENSIONS.items() for x in (F.lit(dim), F.lit(v[i]))])[F.col("sort_by")] for i in (2, 3))
    score = F.coalesce(round_dec("AvgScore", 2).cast("string"), F.lit("None"))
    found = F.concat(F.lit("Hotel: "), F.coalesce("Hotel", F.lit("None")), F.lit(" ("), label, F.lit(": "), score, F.lit(")"))
    missing = F.replace(message, F.lit("{scope}"), F.col("where"))
    return asked.join(best, ["sort_by", "scope", "key"], "left").select(
        "request_id", F.coalesce("pos", F.lit(1)).alias("pos"), F.when(F.col("pos").isNotNull(), found).otherwise(missing).alias("line"))


def best_hotel_lines(g: Graph, dim: str, city: str | None = None, country: str | None = None, k: int = HOTELS_K) -> DataFrame:
    """(line) of one request in order: the best hotels, or the message that there are none."""
    if dim not in DIMENSIONS:
        raise ValueError(dim)
    one = g.hotel.sparkSession.createDataFrame([(0, dim, city or None, country or None)], "request_id int, sort_by string, city string, country string")
    return best_hotel_answers(g, one, k).orderBy("pos").select("line")


def place_requests(g: Graph) -> DataFrame:
    """Requests for every dimension and every city, every country and all hotels."""
    places = (g.city.select(F.col("name").alias("city"), F.lit(None).cast("string").alias("country"))
              .unionByName(g.country.select(F.lit(None).cast("string").alias("city"), F.col("name").alias("country")))
              .unionByName(g.hotel.sparkSession.range(1).select(F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("country"))))
    each = places.withColumn("sort_by", F.explode(F.array(*map(F.lit, DIMENSIONS))))
    return each.select(F.concat_ws("/", "sort_by", F.coalesce("city", F.lit("")), F.coalesce("country", F.lit(""))).alias("request_id"), "sort_by", "city", "country")


def best_hotels_global(g: Graph, dim: str, k: int = HOTELS_K) -> DataFrame:
    """Global form as a single top-k (TakeOrderedAndProject, no window)."""
    metric = DIMENSIONS[dim][0]
    per = merge_by(with_hotel_name(hotel_states(g, [metric]), g), ["name"], [metric]).where(F.col(f"{metric}_n") > 0)
    out = per.select(F.col("name").alias("Hotel"), avg_of(metric).alias("AvgScore"))
    return top_k(out, [_desc("AvgScore"), F.asc_nulls_last("Hotel")], k)


# ---------------------------------------------------------------- materialised index
def all_age_lists() -> list[list[str]]:
    """Every list an age range can map to: the contiguous runs of the fixed
    group table (15 for 5 groups)."""
    from ..functions.text import AGE_GROUPS

    labels = [g[0] for g in AGE_GROUPS]
    return [labels[i:j] for i in range(len(labels)) for j in range(i + 1, len(labels) + 1)]


def list_key(groups: list[str]) -> str:
    return "[" + ", ".join(f"'{g}'" for g in groups) + "]"


def all_age_requests(spark) -> DataFrame:
    rows = [(list_key(lst), a) for lst in all_age_lists() for a in lst]
    return spark.createDataFrame(rows, "groups_key string, age string")


@dataclass
class RetrievalIndex:
    """Every retrieval answer for every parameter value, written once per graph.
    A batch of questions joins these small tables (at most k rows per value)."""
    r1: DataFrame    # city_key, pos, Hotel, Score
    r2: DataFrame    # country_key, pos, Hotel, Score
    r3: DataFrame    # type_key, pos, hotelName, avgRating
    r4: DataFrame    # type_key, pos, Country, avgRating
    r5: DataFrame    # gender_key, pos, Country, Visits
    r6: DataFrame    # groups_key, pos, Country, Visits   (all 15 age lists)
    r7: DataFrame    # groups_key, pos, Hotel, avgRating
    best: DataFrame  # sort_by, scope, scope_key ('' when global), pos, Hotel, AvgScore
    edges: dict[str, DataFrame] | None = None  # explanation edges by kind, see context.with_edges


def retrieval_index(g: Graph, stage=None) -> RetrievalIndex:
    requests = all_age_requests(g.hotel.sparkSession)
    best = None
    for scope in ("global", "city", "country"):
        t = best_hotels_of(g, scope).select(
            "sort_by", F.lit(scope).alias("scope"), F.coalesce("scope_key", F.lit("")).alias("scope_key"), "pos", "Hotel", "AvgScore")
        best = t if best is None else best.unionByName(t)
    tables = {
        "r1": hotels_by_city_all(g), "r2": hotels_by_country_all(g), "r3": hotels_by_type_all(g),
        "r4": countries_by_type_all(g), "r5": countries_by_gender_all(g),
        "r6": countries_by_age_all(g, requests), "r7": hotels_by_age_all(g, requests), "best": best,
    }
    if stage is not None:
        tables = stage(tables)
    return RetrievalIndex(**tables)
