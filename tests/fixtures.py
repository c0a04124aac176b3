"""Hand-built micro tables for the edge cases of the graph build and queries."""

from tripgraph.sources.schemas import HOTELS, QUESTIONS, REVIEWS, USERS, VISA


def hotels(spark, rows):
    full = []
    for r in rows:
        hid, name, city, country, clean, comfort, fac = r
        full.append((hid, name, city, country, 5, 0.0, 0.0, clean, comfort, fac, 9.0, 9.0, 9.0))
    return spark.createDataFrame(full, HOTELS)


def users(spark, rows):
    return spark.createDataFrame(rows, USERS)


def reviews(spark, rows):
    """rows: (review_id, user_id, hotel_id, overall, clean, comfort, facilities, location, value)."""
    full = [(rid, uid, hid, "2020-01-01", f"text {rid}", ov, cl, co, fa, lo, 8.0, va)
            for rid, uid, hid, ov, cl, co, fa, lo, va in rows]
    return spark.createDataFrame(full, REVIEWS)


def visa(spark, rows):
    return spark.createDataFrame(rows, VISA)


def questions(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], QUESTIONS)


_SMALL = {}


def small_graph(spark):
    """Four hotels in two cities; 'Twin' city exists in two countries.
    Built once per session into written tables (like the real catalog)."""
    key = spark.sparkContext.applicationId
    if key not in _SMALL:
        from tripgraph.operators.graph import build_graph, writing_stage
        from tripgraph.session import scratch_path

        _SMALL[key] = build_graph(*_small_sources(spark), stage=writing_stage(spark, scratch_path(spark, "small")))
    return _SMALL[key]


def lazy_small_graph(spark):
    from tripgraph.operators.graph import build_graph

    return build_graph(*_small_sources(spark))


def _small_sources(spark):

    h = hotels(spark, [
        (1, "Alpha", "Paris", "France", 9.0, 9.0, 9.0),
        (2, "Beta", "Twin", "France", 8.0, 8.0, 8.0),
        (3, "Gamma", "Twin", "Spain", 7.0, 7.0, 7.0),
        (4, "Delta", "Paris", "France", 8.5, 8.5, 8.5),   # no reviews
    ])
    u = users(spark, [
        (10, "Female", "France", "25-34", "Solo"),
        (11, "Male", "Spain", "18-24", "Business"),
        (12, "Female", "Spain", "55+", "Couple"),
    ])
    r = reviews(spark, [
        ("a", 10, 1, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0),
        ("b", 10, 1, 8.0, None, 8.0, 8.0, 8.0, 8.0),
        ("c", 11, 2, 7.0, 7.0, 7.0, 7.0, None, 7.0),
        ("d", 12, 3, 6.0, 6.0, 6.0, 6.0, 6.0, 6.0),
        ("e", 99, 3, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),       # unknown user: dropped from the graph
        ("f", 12, 77, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),      # unknown hotel: dropped
    ])
    v = visa(spark, [
        ("France", "Spain", "Yes", "Tourist Visa"),
        ("Spain", "France", "No", "Visa-Free / eVisa"),
        ("Spain", "Italy", "yes", "Tourist Visa"),        # lower-case: not a visa edge
        ("Italy", "Spain", "True", "Tourist Visa"),
    ])
    return h, u, r, v


def small_sources(spark):
    """(reviews, hotels) of the small graph."""
    h, _, r, _ = _small_sources(spark)
    return r, h
