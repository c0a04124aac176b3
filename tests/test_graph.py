from pyspark.sql import functions as F

from fixtures import hotels, lazy_small_graph, reviews, small_graph, users, visa
from tripgraph.operators.graph import build_graph, check_unique, last_wins


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_last_row_wins(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 5), (1, "c", 2), (2, "x", 1)], "k int, v string, _ord long")
    assert rows(last_wins(df, "k", ["v"]), "k", "v") == [(1, "b"), (2, "x")]


def test_vertices_and_edges(spark):
    g = small_graph(spark)
    assert rows(g.country, "name") == [("France",), ("Italy",), ("Spain",)]
    assert rows(g.city, "name") == [("Paris",), ("Twin",)]
    # A city name shared by two countries gives two LOCATED_IN edges.
    assert rows(g.city_in_country.where("city = 'Twin'"), "country") == [("France",), ("Spain",)]
    # Case-sensitive requires_visa: only 'Yes' and 'True' create edges.
    assert rows(g.needs_visa, "from_country", "to_country") == [("France", "Spain"), ("Italy", "Spain")]


def test_reviews_need_both_endpoints(spark):
    g = small_graph(spark)
    assert rows(g.review, "review_id") == [("a",), ("b",), ("c",), ("d",)]
    # STAYED_AT collapses repeated stays.
    assert g.stayed_at.where("user_id = 10").count() == 1


def test_hotel_average_uses_all_reviews_and_zero_when_absent(spark):
    g = small_graph(spark)
    avg = dict(rows(g.hotel, "hotel_id", "average_reviews_score"))
    assert avg[1] == 8.5
    assert avg[3] == 3.5          # includes the orphan review 'e'
    assert avg[4] == 0.0          # no review at all


def test_nan_scores_are_null(spark):
    h = hotels(spark, [(1, "A", "C", "X", 8.0, 8.0, 8.0)])
    u = users(spark, [(1, "Male", "X", "18-24", "Solo")])
    r = reviews(spark, [("a", 1, 1, float("nan"), 8.0, 8.0, 8.0, 8.0, 8.0), ("b", 1, 1, 6.0, 8.0, 8.0, 8.0, 8.0, 8.0)])
    g = build_graph(h, u, r, visa(spark, [("X", "Y", "No", "-")]))
    assert rows(g.hotel, "average_reviews_score") == [(6.0,)]


def test_build_is_idempotent_and_order_free(spark):
    g1 = small_graph(spark)
    g2 = lazy_small_graph(spark)
    for name in ("hotel", "stayed_at", "segment_stats", "hotel_stats"):
        a, b = getattr(g1, name), getattr(g2, name)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert check_unique(g1).count() == 0


def test_segment_states_merge_exactly(spark):
    g = small_graph(spark)
    tot = g.segment_stats.agg(F.sum("paths"), F.sum("score_overall_sum"), F.sum("score_overall_n")).first()
    assert tuple(tot) == (4, 30, 4)


def test_merge_summary(spark):
    from fixtures import _small_sources
    from tripgraph.operators.graph import merge_summary

    h, u, r, v = _small_sources(spark)
    got = {row["label"]: (row["input_rows"], row["vertices"])
           for row in merge_summary(small_graph(spark), {"hotels": h, "users": u, "reviews": r}).collect()}
    assert got == {"Hotel": (4, 4), "Traveller": (3, 3), "Review": (6, 4), "City": (4, 2)}


def test_repeated_keys_with_other_values(spark):
    """The same review twice by two users, a hotel with two names, a user with two types: the last row gives
    the properties, all rows give the edges."""
    h = hotels(spark, [(1, "First", "C", "X", 8.0, 8.0, 8.0), (1, "Second", "C", "X", 7.0, 7.0, 7.0)]).withColumn(
        "_ord", F.when(F.col("hotel_name") == "First", 2).otherwise(1))
    u = users(spark, [(1, "Male", "X", "18-24", "Solo"), (2, "Male", "X", "55+", "Solo"), (1, "Female", "Y", "25-34", "Group")]).withColumn(
        "_ord", F.when(F.col("traveller_type") == "Group", 2).otherwise(1))
    r = reviews(spark, [("a", 1, 1, 9.0, 8.0, 8.0, 8.0, 8.0, 8.0), ("a", 2, 1, 5.0, 8.0, 8.0, 8.0, 8.0, 8.0)]).withColumn(
        "_ord", F.when(F.col("user_id") == 1, 1).otherwise(2))
    g = build_graph(h, u, r, visa(spark, [("X", "Y", "No", "-")]))
    assert rows(g.hotel, "name", "cleanliness_base", "average_reviews_score") == [("First", 8.0, 7.0)]
    assert rows(g.traveller, "user_id", "type", "gender") == [(1, "Group", "Female"), (2, "Solo", "Male")]
    assert rows(g.review, "review_id", "score_overall") == [("a", 5.0)]
    assert rows(g.wrote, "user_id", "review_id") == [(1, "a"), (2, "a")]
    assert rows(g.from_country, "user_id", "country") == [(1, "X"), (1, "Y"), (2, "X")]
    # Both writers' paths carry the review's last score.
    assert rows(g.segment_stats, "type", "paths", "score_overall_sum") == [("Group", 1, 5), ("Solo", 1, 5)]
    assert check_unique(g).count() == 0
