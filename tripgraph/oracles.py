"""DuckDB oracle SQL: the fixture views, the graph as CTEs, and one query per
registered key. Written independently of the Spark code path (plain joins over
the raw edge tables instead of the pre-aggregated states), so a wrong state or
merge in the engine shows up as a mismatch.

Of source rows that repeat a key the oracle takes the last by ``_ord``, as the
graph build must; ``check_unique`` is expected to be empty.
"""

from __future__ import annotations

from .functions.agg import sql_avg, sql_round
from .sources.fixtures import duckdb_fixture_ctes

GRAPH_CTES = f"""
visa_yes AS (SELECT * FROM visa WHERE requires_visa IN ('Yes', '1', 'True')
             AND from_country IS NOT NULL AND to_country IS NOT NULL),
hotel_avg AS (SELECT hotel_id, {sql_avg('score_overall')} AS average_reviews_score
              FROM reviews WHERE hotel_id IS NOT NULL GROUP BY hotel_id),
hotel AS (SELECT h.hotel_id, h.hotel_name AS name, h.star_rating, h.cleanliness_base, h.comfort_base, h.facilities_base,
                 COALESCE(a.average_reviews_score, 0.0) AS average_reviews_score
          FROM (SELECT * FROM hotels WHERE hotel_id IS NOT NULL
                QUALIFY row_number() OVER (PARTITION BY hotel_id ORDER BY _ord DESC) = 1) h
          LEFT JOIN hotel_avg a ON h.hotel_id = a.hotel_id),
city AS (SELECT DISTINCT city AS name FROM hotels WHERE city IS NOT NULL),
country AS (SELECT country AS name FROM hotels WHERE country IS NOT NULL
            UNION SELECT country FROM users WHERE country IS NOT NULL
            UNION SELECT from_country FROM visa_yes UNION SELECT to_country FROM visa_yes),
city_in_country AS (SELECT DISTINCT city, country FROM hotels WHERE city IS NOT NULL AND country IS NOT NULL),
hotel_in_city AS (SELECT DISTINCT hotel_id, city FROM hotels WHERE hotel_id IS NOT NULL AND city IS NOT NULL),
traveller AS (SELECT user_id, age_group AS age, traveller_type AS type, user_gender AS gender
              FROM users WHERE user_id IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY _ord DESC) = 1),
from_country AS (SELECT DISTINCT user_id, country FROM users WHERE user_id IS NOT NULL AND country IS NOT NULL),
live_reviews AS (SELECT * FROM reviews WHERE review_id IS NOT NULL
                 AND user_id IN (SELECT user_id FROM traveller) AND hotel_id IN (SELECT hotel_id FROM hotel)),
review AS (SELECT review_id, review_text AS text, review_date AS date, score_overall, score_cleanliness, score_comfort,
                  score_facilities, score_location, score_staff, score_value_for_money FROM live_reviews
           QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY _ord DESC) = 1),
wrote AS (SELECT DISTINCT user_id, review_id FROM live_reviews),
reviewed AS (SELECT DISTINCT review_id, hotel_id FROM live_reviews),
stayed_at AS (SELECT DISTINCT user_id, hotel_id FROM live_reviews),
needs_visa AS (SELECT from_country, to_country, max(visa_type) AS visa_type FROM visa_yes GROUP BY from_country, to_country),
hotel_place AS (SELECT hc.hotel_id, hc.city, cc.country FROM hotel_in_city hc JOIN city_in_country cc ON hc.city = cc.city),
hr AS (SELECT r.*, v.hotel_id FROM review r JOIN reviewed v ON r.review_id = v.review_id),
trh AS (SELECT hr.*, t.user_id, t.age, t.type, t.gender FROM hr JOIN wrote w ON hr.review_id = w.review_id
        JOIN traveller t ON w.user_id = t.user_id)
"""


def with_graph(body: str) -> str:
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {duckdb_fixture_ctes()},\n{GRAPH_CTES},\n{body[4:]}"
    return f"WITH {duckdb_fixture_ctes()},\n{GRAPH_CTES}\n{body}"


A = sql_avg
R = sql_round

Q_SQL = {
    "q1_visa_free_travellers": f"""
        SELECT count(DISTINCT s.user_id) AS TravellerCount
        FROM stayed_at s JOIN hotel_place p ON s.hotel_id = p.hotel_id JOIN from_country f ON s.user_id = f.user_id
        WHERE NOT EXISTS (SELECT 1 FROM needs_visa n WHERE n.from_country = f.country AND n.to_country = p.country)""",
    "q1_by_home_country": f"""
        SELECT f.country AS HomeCountry, count(DISTINCT s.user_id) AS TravellerCount
        FROM stayed_at s JOIN hotel_place p ON s.hotel_id = p.hotel_id JOIN from_country f ON s.user_id = f.user_id
        WHERE NOT EXISTS (SELECT 1 FROM needs_visa n WHERE n.from_country = f.country AND n.to_country = p.country)
        GROUP BY f.country""",
    "q2_top_business_hotels": f"""
        SELECT h.name AS hotelName, {A('trh.score_overall')} AS avgRating
        FROM trh JOIN hotel h ON trh.hotel_id = h.hotel_id WHERE trh.type = 'Business'
        GROUP BY h.name ORDER BY avgRating DESC NULLS LAST, hotelName ASC NULLS LAST LIMIT 3""",
    "q3_couples_per_hotel": """
        SELECT h.name AS HotelName, CAST(count(t.user_id) AS BIGINT) AS CoupleTravellerCount
        FROM hotel h LEFT JOIN (stayed_at s JOIN traveller t ON s.user_id = t.user_id AND t.type = 'Couple')
             ON s.hotel_id = h.hotel_id
        GROUP BY h.name ORDER BY HotelName ASC NULLS LAST""",
    "q4_least_clean": f"""
        SELECT HotelName, AverageCleanliness FROM (
          SELECT h.hotel_id, h.name AS HotelName, {A('hr.score_cleanliness')} AS AverageCleanliness
          FROM hr JOIN hotel h ON hr.hotel_id = h.hotel_id GROUP BY h.hotel_id, h.name) x
        WHERE AverageCleanliness < 8.8
        ORDER BY AverageCleanliness ASC, HotelName ASC NULLS LAST, hotel_id ASC LIMIT 3""",
    "q5_best_location_women": f"""
        WITH s AS (SELECT h.hotel_id, h.name AS HotelName, {A('trh.score_location')} AS AverageLocationScore
                   FROM trh JOIN hotel h ON trh.hotel_id = h.hotel_id WHERE trh.gender = 'Female'
                   GROUP BY h.hotel_id, h.name)
        SELECT HotelName, AverageLocationScore FROM s
        WHERE AverageLocationScore = (SELECT max(AverageLocationScore) FROM s)""",
    "q6_improvement_rule": f"""
        WITH per AS (
          SELECT trh.age AS age_group, h.hotel_id,
                 h.cleanliness_base + h.comfort_base + h.facilities_base AS hotel_base_sum,
                 {A('trh.score_cleanliness + trh.score_comfort + trh.score_facilities')} AS avg_review_score
          FROM trh JOIN hotel h ON trh.hotel_id = h.hotel_id
          WHERE trh.type = 'Solo' AND trh.gender = 'Female'
          GROUP BY trh.age, h.hotel_id, h.cleanliness_base, h.comfort_base, h.facilities_base),
        pct AS (SELECT age_group, 100.0 * (hotel_base_sum - avg_review_score) / NULLIF(avg_review_score, 0) AS improvement_pct
                FROM per WHERE hotel_base_sum >= avg_review_score)
        SELECT age_group, {R('min(improvement_pct)', 2)} AS min_improve, {R('max(improvement_pct)', 2)} AS max_improve,
               {R(A('improvement_pct'), 2)} AS avg_improve
        FROM pct GROUP BY age_group ORDER BY age_group ASC NULLS LAST""",
}


def oracle_queries() -> dict[str, str]:
    return {k: with_graph(v) for k, v in Q_SQL.items()}


def _ranked(inner: str, part: str, order: str, k: int, cols: str) -> str:
    return (f"SELECT {cols} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS INTEGER) AS pos "
            f"FROM ({inner}) x) y WHERE pos <= {k}")


DICT_SQL = """
SELECT DISTINCT category, value FROM (
  SELECT 'City' AS category, name AS value FROM city
  UNION ALL SELECT 'Country', name FROM country
  UNION ALL SELECT 'Hotel', name FROM hotel
  UNION ALL SELECT 'Traveller Type', type FROM traveller
  UNION ALL SELECT 'Gender', gender FROM traveller
  UNION ALL SELECT 'Age Group', age FROM traveller) d
WHERE value IS NOT NULL AND value <> ''"""

LINK_SQL = f"""
SELECT question_id, category, value FROM (
  SELECT q.question_id, d.category, d.value,
         row_number() OVER (PARTITION BY q.question_id, d.category ORDER BY length(d.value) DESC, d.value ASC) AS rk
  FROM questions q JOIN ({DICT_SQL}) d ON contains(lower(q.user_query), lower(d.value))
  WHERE d.category <> 'Age Group' AND length(lower(d.value)) > 0 AND q.user_query IS NOT NULL) z
WHERE rk = 1"""


def _age_sql():
    from .functions.text import AGE_PATTERN
    pat = AGE_PATTERN
    lc = "lower(user_query)"
    hit = f"regexp_extract({lc}, '{pat}', 0) <> ''"
    lo = f"CASE WHEN {hit} THEN TRY_CAST(regexp_extract({lc}, '{pat}', 1) AS BIGINT) END"
    hi = f"CASE WHEN {hit} THEN TRY_CAST(regexp_extract({lc}, '{pat}', 2) AS BIGINT) END"
    return lo, hi


def _understand_sql() -> str:
    from .functions.text import sql_age_groups, sql_sort_intent
    lo, hi = _age_sql()
    return f"""
SELECT q.question_id, q.user_query,
       max(CASE WHEN l.category = 'City' THEN l.value END) AS city,
       max(CASE WHEN l.category = 'Country' THEN l.value END) AS country,
       max(CASE WHEN l.category = 'Hotel' THEN l.value END) AS hotel,
       max(CASE WHEN l.category = 'Traveller Type' THEN l.value END) AS traveller_type,
       max(CASE WHEN l.category = 'Gender' THEN l.value END) AS gender,
       any_value(a.age_min) AS age_min, any_value(a.age_max) AS age_max,
       any_value(CASE WHEN len(a.groups) > 0 THEN a.groups END) AS age_groups,
       any_value({sql_sort_intent('lower(q.user_query)')}) AS sort_by,
       any_value(contains(lower(q.user_query), 'country') OR contains(lower(q.user_query), 'countries')) AS country_mode
FROM questions q
LEFT JOIN ({LINK_SQL}) l ON q.question_id = l.question_id
LEFT JOIN (SELECT question_id, age_min, age_max, {sql_age_groups('age_min', 'age_max')} AS groups
           FROM (SELECT question_id, {lo} AS age_min, {hi} AS age_max FROM questions) r) a ON q.question_id = a.question_id
GROUP BY q.question_id, q.user_query"""


def _list_repr(x: str) -> str:
    return f"'[' || array_to_string(list_transform({x}, lambda g: '''' || g || ''''), ', ') || ']'"


A_ = sql_avg
GRAPH_SQL = {
    "nodes_country": "SELECT name FROM country",
    "nodes_city": "SELECT name FROM city",
    "nodes_hotel": "SELECT * FROM hotel",
    "nodes_traveller": "SELECT * FROM traveller",
    "nodes_review": "SELECT * FROM review",
    "edge_city_country": "SELECT * FROM city_in_country",
    "edge_hotel_city": "SELECT * FROM hotel_in_city",
    "edge_from_country": "SELECT * FROM from_country",
    "edge_wrote": "SELECT * FROM wrote",
    "edge_reviewed": "SELECT * FROM reviewed",
    "edge_stayed_at": "SELECT * FROM stayed_at",
    "edge_needs_visa": "SELECT * FROM needs_visa",
    "check_unique_sources": " UNION ALL ".join(
        f"SELECT '{label}' AS label, CAST({key} AS VARCHAR) AS key, count(*) AS n FROM {table} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1"
        for label, key, table in (("hotel", "hotel_id", "hotels"), ("traveller", "user_id", "users"), ("review", "review_id", "reviews"))),
    "merge_hotel": "SELECT * FROM hotel",
    "merge_review": "SELECT * FROM review",
    "merge_stayed_at": "SELECT * FROM stayed_at",
    "merge_hotel_place": "SELECT h.hotel_id, h.city, c.country FROM hotel_in_city h JOIN city_in_country c ON h.city = c.city",
    "merge_segments": "SELECT d.hotel_id, t.age, t.type, t.gender, count(*) AS paths, "
                      "CAST(sum(CAST(r.score_overall AS DECIMAL(18,6))) AS DOUBLE) AS score_overall_sum, count(r.score_overall) AS score_overall_n, "
                      "CAST(sum(CAST(r.score_cleanliness + r.score_comfort + r.score_facilities AS DECIMAL(18,6))) AS DOUBLE) AS base3_sum, "
                      "count(r.score_cleanliness + r.score_comfort + r.score_facilities) AS base3_n "
                      "FROM review r JOIN reviewed d ON r.review_id = d.review_id JOIN wrote w ON r.review_id = w.review_id "
                      "JOIN traveller t ON w.user_id = t.user_id GROUP BY d.hotel_id, t.age, t.type, t.gender",
    "hotel_avg_score": "SELECT hotel_id, average_reviews_score FROM hotel",
    "check_unique": "SELECT CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS BIGINT) AS n WHERE false",
    "merge_nodes": "SELECT 'Hotel' AS label, (SELECT count(*) FROM hotels WHERE hotel_id IS NOT NULL) AS input_rows, "
                   "(SELECT count(*) FROM hotel) AS vertices "
                   "UNION ALL SELECT 'Traveller', (SELECT count(*) FROM users WHERE user_id IS NOT NULL), (SELECT count(*) FROM traveller) "
                   "UNION ALL SELECT 'Review', (SELECT count(*) FROM reviews WHERE review_id IS NOT NULL), (SELECT count(*) FROM review) "
                   "UNION ALL SELECT 'City', (SELECT count(*) FROM hotels WHERE city IS NOT NULL), (SELECT count(*) FROM city)",
    "src_hotels": "SELECT * FROM hotels",
    "src_users": "SELECT * FROM users",
    "src_reviews": "SELECT * FROM reviews",
    "src_visa": "SELECT * FROM visa",
    "entity_dict": DICT_SQL,
    "entity_link": LINK_SQL,
    "age_range": "SELECT question_id, age_min, age_max FROM (SELECT question_id, {lo} AS age_min, {hi} AS age_max FROM questions) r WHERE age_min IS NOT NULL",
    "age_groups": "SELECT question_id, {repr} AS age_groups FROM (SELECT question_id, {groups} AS g FROM (SELECT question_id, {lo} AS age_min, {hi} AS age_max FROM questions) r WHERE age_min IS NOT NULL) s WHERE len(g) > 0",
    "sort_intent": "SELECT question_id, sort_by FROM (SELECT question_id, {sort} AS sort_by FROM questions) s WHERE sort_by IS NOT NULL",
    "route": "SELECT question_id, city, country, hotel, traveller_type, gender, CASE WHEN age_groups IS NOT NULL THEN {urepr} END AS age_groups, sort_by, country_mode FROM ({understand}) u",
}


def _graph_sql() -> dict[str, str]:
    from .functions.text import sql_age_groups, sql_sort_intent
    lo, hi = _age_sql()
    fmt = dict(lo=lo, hi=hi, groups=sql_age_groups("age_min", "age_max"), repr=_list_repr("g"),
               sort=sql_sort_intent("lower(user_query)"), urepr=_list_repr("age_groups"), understand=_understand_sql())
    return {k: (v.format(**fmt) if "{" in v else v) for k, v in GRAPH_SQL.items()}


_NAME_ORDER = "{s} DESC NULLS LAST, {l} ASC NULLS LAST"


def _retrieval_sql() -> dict[str, str]:
    from .plans.retrieval import DIMENSIONS
    out = {
        "r1_hotels_by_city": _ranked(
            "SELECT lower(hc.city) AS city_key, h.hotel_id, h.name AS Hotel, h.average_reviews_score AS Score "
            "FROM hotel_in_city hc JOIN hotel h ON hc.hotel_id = h.hotel_id",
            "city_key", "Score DESC NULLS LAST, Hotel ASC NULLS LAST, hotel_id ASC", 5, "city_key, pos, Hotel, Score"),
        "r2_hotels_by_country": _ranked(
            "SELECT lower(p.country) AS country_key, h.hotel_id, h.name AS Hotel, h.average_reviews_score AS Score "
            "FROM hotel_place p JOIN hotel h ON p.hotel_id = h.hotel_id",
            "country_key", "Score DESC NULLS LAST, Hotel ASC NULLS LAST, hotel_id ASC", 5, "country_key, pos, Hotel, Score"),
        "r3_hotels_by_type": _ranked(
            f"SELECT lower(trh.type) AS type_key, h.name AS hotelName, {A_('trh.score_overall')} AS avgRating "
            "FROM trh JOIN hotel h ON trh.hotel_id = h.hotel_id WHERE trh.type IS NOT NULL GROUP BY lower(trh.type), h.name",
            "type_key", "avgRating DESC NULLS LAST, hotelName ASC NULLS LAST", 3, "type_key, pos, hotelName, avgRating"),
        "r4_countries_by_type": _ranked(
            f"SELECT lower(trh.type) AS type_key, p.country AS Country, {A_('trh.score_overall')} AS avgRating "
            "FROM trh JOIN hotel_place p ON trh.hotel_id = p.hotel_id WHERE trh.type IS NOT NULL "
            "GROUP BY lower(trh.type), p.country",
            "type_key", "avgRating DESC NULLS LAST, Country ASC NULLS LAST", 3, "type_key, pos, Country, avgRating"),
        "r5_countries_by_gender": _ranked(
            "SELECT lower(trh.gender) AS gender_key, p.country AS Country, CAST(count(*) AS BIGINT) AS Visits "
            "FROM trh JOIN hotel_place p ON trh.hotel_id = p.hotel_id WHERE trh.gender IS NOT NULL "
            "GROUP BY lower(trh.gender), p.country",
            "gender_key", "Visits DESC NULLS LAST, Country ASC NULLS LAST", 3, "gender_key, pos, Country, Visits"),
    }
    reqs = (f"SELECT DISTINCT {_list_repr('age_groups')} AS groups_key, unnest(age_groups) AS age "
            f"FROM ({_understand_sql()}) u WHERE age_groups IS NOT NULL")
    out["r6_countries_by_age"] = _ranked(
        f"SELECT rq.groups_key, p.country AS Country, CAST(count(*) AS BIGINT) AS Visits "
        f"FROM trh JOIN ({reqs}) rq ON trh.age = rq.age JOIN hotel_place p ON trh.hotel_id = p.hotel_id "
        "GROUP BY rq.groups_key, p.country",
        "groups_key", "Visits DESC NULLS LAST, Country ASC NULLS LAST", 3, "groups_key, pos, Country, Visits")
    out["r7_hotels_by_age"] = _ranked(
        f"SELECT rq.groups_key, h.name AS Hotel, {A_('trh.score_overall')} AS avgRating "
        f"FROM trh JOIN ({reqs}) rq ON trh.age = rq.age JOIN hotel h ON trh.hotel_id = h.hotel_id "
        "GROUP BY rq.groups_key, h.name",
        "groups_key", "avgRating DESC NULLS LAST, Hotel ASC NULLS LAST", 3, "groups_key, pos, Hotel, avgRating")
    for num, dim in zip((8, 9, 10, 11), ("Cleanliness", "Value", "Location", "Comfort")):
        col = DIMENSIONS[dim][0]
        name = dim.lower()
        scopes = {
            "global": ("CAST(NULL AS VARCHAR)", ""),
            "city": ("lower(hc.city)", "JOIN hotel_in_city hc ON hr.hotel_id = hc.hotel_id"),
            "country": ("lower(p.country)", "JOIN hotel_place p ON hr.hotel_id = p.hotel_id"),
        }
        for scope, (key, join) in scopes.items():
            inner = (f"SELECT {key} AS scope_key, h.name AS Hotel, {A_('hr.' + col)} AS AvgScore "
                     f"FROM hr JOIN hotel h ON hr.hotel_id = h.hotel_id {join} WHERE hr.{col} IS NOT NULL "
                     f"GROUP BY {key}, h.name")
            out[f"r{num}_{name}_{scope}"] = _ranked(inner, "scope_key", "AvgScore DESC NULLS LAST, Hotel ASC NULLS LAST",
                                                   5, "scope_key, pos, Hotel, AvgScore")
    return out


def _best_answers_sql() -> str:
    """Hotels of every dimension and place, or the dimension's message."""
    from .plans.retrieval import DIMENSIONS

    r = _retrieval_sql()
    best = " UNION ALL ".join(
        f"SELECT '{dim}' AS sort_by, '{scope}' AS scope, COALESCE(scope_key, '') AS key, pos, 'Hotel: ' || COALESCE(Hotel, 'None') || ' ({v[2]}: ' || "
        f"COALESCE(CAST({R('AvgScore', 2)} AS VARCHAR), 'None') || ')' AS line FROM ({r[f'r{n}_{dim.lower()}_{scope}']}) b{n}{scope}"
        for n, (dim, v) in zip((8, 9, 10, 11), DIMENSIONS.items()) for scope in ("global", "city", "country"))
    dims = ", ".join(f"('{d}', '{v[3]}')" for d, v in DIMENSIONS.items())
    return f"""
SELECT q.sort_by || '/' || COALESCE(q.city, '') || '/' || COALESCE(q.country, '') AS request_id, COALESCE(best.pos, 1) AS pos,
       COALESCE(best.line, replace(q.message, '{{scope}}', COALESCE('in ' || COALESCE(q.city, q.country), 'Globally'))) AS line
FROM (SELECT * FROM (VALUES {dims}) d(sort_by, message),
      (SELECT name AS city, CAST(NULL AS VARCHAR) AS country FROM city UNION ALL SELECT NULL, name FROM country UNION ALL SELECT NULL, NULL) p) q
LEFT JOIN ({best}) best ON q.sort_by = best.sort_by AND COALESCE(lower(q.city), lower(q.country), '') = best.key
  AND CASE WHEN q.city IS NOT NULL THEN 'city' WHEN q.country IS NOT NULL THEN 'country' ELSE 'global' END = best.scope"""


_RANGE_OVERLAP_SQL = """
WITH o AS (SELECT o_orderkey, c_nationkey, CAST(o_orderdate AS DATE) AS placed FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT c_nationkey, CAST(year(placed) AS INTEGER) AS year, min(placed) AS first, max(placed) AS last FROM o GROUP BY 1, 2),
r AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS shipped FROM lineitem GROUP BY 1),
w AS (SELECT o_orderkey, placed, COALESCE(shipped, DATE '9999-01-01') AS shipped FROM o LEFT JOIN r ON o_orderkey = l_orderkey)
SELECT c_nationkey, year, count(*) AS n_orders, CAST(sum(o_orderkey) AS BIGINT) AS order_keys
FROM s JOIN w ON w.placed <= s.last AND s.first <= w.shipped AND w.placed <= w.shipped GROUP BY c_nationkey, year"""


def all_oracles() -> dict[str, str]:
    out = {"best_hotel_answers": with_graph(_best_answers_sql()), "range_overlap": _RANGE_OVERLAP_SQL}
    out |= {k: with_graph(v) for k, v in Q_SQL.items()}
    out.update({k: with_graph(v) for k, v in _graph_sql().items()})
    out.update({k: with_graph(v) for k, v in _retrieval_sql().items()})
    z = _z_sql()
    z["z9_city_fallback_edges"] = z["z1_city_edges"]
    out.update({k: with_graph(v) for k, v in z.items()})
    out["z_explain_edges"] = with_graph(_explain_edges_sql())
    out.update({k: with_graph(v) for k, v in _text_sql().items()})
    out.update({k: with_graph(v) for k, v in _context_sql().items()})
    return out


# ----------------------------------------------------------------------------- explanation edges
def _edges_sql(body: str, key: str) -> str:
    """``body`` selects (key, source, rel, target); keep 5 distinct edges per key."""
    return (f"SELECT {key}, source, rel, target, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {key} "
            f"ORDER BY source ASC NULLS LAST, target ASC NULLS LAST, rel ASC) AS INTEGER) AS pos "
            f"FROM (SELECT DISTINCT * FROM ({body}) b) e) x WHERE pos <= 5")


def _z_sql() -> dict[str, str]:
    hn = "JOIN hotel h ON {t}.hotel_id = h.hotel_id"
    z = {
        "z1_city_edges": _edges_sql(
            "SELECT lower(hc.city) AS city_key, h.name AS source, 'LOCATED_IN' AS rel, hc.city AS target "
            f"FROM hotel_in_city hc {hn.format(t='hc')}", "city_key"),
        "z2_country_edges": _edges_sql(
            "SELECT lower(p.country) AS country_key, h.name AS source, 'LOCATED_IN' AS rel, p.country AS target "
            f"FROM hotel_place p {hn.format(t='p')}", "country_key"),
        "z3_type_edges": _edges_sql(
            "SELECT lower(trh.type) AS type_key, trh.type || ' Traveller' AS source, 'LIKES' AS rel, h.name AS target "
            f"FROM trh {hn.format(t='trh')} WHERE trh.type IS NOT NULL", "type_key"),
        "z4_gender_edges": _edges_sql(
            "SELECT lower(trh.gender) AS gender_key, trh.gender || ' Traveller' AS source, 'VISITED' AS rel, p.country AS target "
            "FROM trh JOIN hotel_place p ON trh.hotel_id = p.hotel_id WHERE trh.gender IS NOT NULL", "gender_key"),
        "z5_age_edges": _edges_sql(
            "SELECT trh.age AS age, 'Age Group ' || trh.age AS source, 'RATED_HIGHLY' AS rel, h.name AS target "
            f"FROM trh {hn.format(t='trh')} WHERE trh.age IS NOT NULL", "age"),
        "z6_city_top_edges": _edges_sql(
            "SELECT lower(hc.city) AS city_key, hc.city AS source, 'CONTAINS_TOP_HOTEL' AS rel, h.name AS target "
            f"FROM hotel_in_city hc {hn.format(t='hc')}", "city_key"),
        "z7_country_top_edges": _edges_sql(
            "SELECT lower(p.country) AS country_key, p.country AS source, 'CONTAINS_TOP_HOTEL' AS rel, h.name AS target "
            f"FROM hotel_place p {hn.format(t='p')}", "country_key"),
        "z10_country_fallback_edges": _edges_sql(
            "SELECT lower(p.country) AS country_key, p.country AS source, 'LOCATED_IN' AS rel, h.name AS target "
            f"FROM hotel_place p {hn.format(t='p')}", "country_key"),
    }
    r = _retrieval_sql()
    z["z8_global_sort_edges"] = " UNION ALL ".join(
        f"SELECT '{dim}' AS sort_by, pos, 'Global Top' AS source, 'BEST_{dim.upper()}' AS rel, Hotel AS target "
        f"FROM ({r[key]}) g{i}"
        for i, (dim, key) in enumerate([("Cleanliness", "r8_cleanliness_global"), ("Value", "r9_value_global"),
                                        ("Location", "r10_location_global"), ("Comfort", "r11_comfort_global")]))
    return z


def _explain_edges_sql() -> str:
    z = _z_sql()
    reqs = (f"SELECT DISTINCT {_list_repr('age_groups')} AS groups_key, unnest(age_groups) AS age "
            f"FROM ({_understand_sql()}) u0 WHERE age_groups IS NOT NULL")
    return f"""
WITH u AS ({_understand_sql()}),
r1k AS (SELECT DISTINCT lower(city) AS k FROM hotel_in_city),
r2k AS (SELECT DISTINCT lower(country) AS k FROM hotel_place),
r3k AS (SELECT DISTINCT lower(type) AS k FROM trh WHERE type IS NOT NULL),
r5k AS (SELECT DISTINCT lower(trh.gender) AS k FROM trh JOIN hotel_place p ON trh.hotel_id = p.hotel_id WHERE trh.gender IS NOT NULL),
r7k AS (SELECT DISTINCT rq.groups_key AS k FROM ({reqs}) rq JOIN trh ON trh.age = rq.age),
z1 AS ({z['z1_city_edges']}), z2 AS ({z['z2_country_edges']}), z3 AS ({z['z3_type_edges']}),
z4 AS ({z['z4_gender_edges']}), z5 AS ({z['z5_age_edges']}), z8 AS ({z['z8_global_sort_edges']}),
e AS (
  SELECT u.question_id, 1 AS section, z1.pos, z1.source, z1.rel, z1.target FROM u JOIN z1 ON lower(u.city) = z1.city_key
    WHERE lower(u.city) IN (SELECT k FROM r1k)
  UNION ALL SELECT u.question_id, 2, z2.pos, z2.source, z2.rel, z2.target FROM u JOIN z2 ON lower(u.country) = z2.country_key
    WHERE lower(u.country) IN (SELECT k FROM r2k)
  UNION ALL SELECT u.question_id, 3, z3.pos, z3.source, z3.rel, z3.target FROM u JOIN z3 ON lower(u.traveller_type) = z3.type_key
    WHERE NOT u.country_mode AND lower(u.traveller_type) IN (SELECT k FROM r3k)
  UNION ALL SELECT u.question_id, 4, z4.pos, z4.source, z4.rel, z4.target FROM u JOIN z4 ON lower(u.gender) = z4.gender_key
    WHERE lower(u.gender) IN (SELECT k FROM r5k)
  UNION ALL SELECT u.question_id, 5, z5.pos, z5.source, z5.rel, z5.target FROM u JOIN z5 ON u.age_groups[1] = z5.age
    WHERE NOT u.country_mode AND u.age_groups IS NOT NULL AND {_list_repr('u.age_groups')} IN (SELECT k FROM r7k)),
s AS (SELECT * FROM u WHERE sort_by IS NOT NULL AND question_id NOT IN (SELECT question_id FROM e)),
f AS (
  SELECT s.question_id, 6 AS section, z1.pos, z1.source, z1.rel, z1.target FROM s JOIN z1 ON lower(s.city) = z1.city_key
    WHERE s.city IS NOT NULL
  UNION ALL SELECT s.question_id, 6, z2.pos, z2.source, z2.rel, z2.target FROM s JOIN z2 ON lower(s.country) = z2.country_key
    WHERE s.city IS NULL AND s.country IS NOT NULL
  UNION ALL SELECT s.question_id, 6, z8.pos, z8.source, z8.rel, z8.target FROM s JOIN z8 ON s.sort_by = z8.sort_by
    WHERE s.city IS NULL AND s.country IS NULL),
a AS (SELECT * FROM e UNION ALL SELECT * FROM f),
fe AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, source, target ORDER BY section, pos) AS r FROM a) x WHERE r = 1)
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY section, pos) AS INTEGER) AS seq, source, rel, target
FROM fe"""


# ----------------------------------------------------------------------------- text and vectors
def _separator_chunks_sql(table: str, id_col: str, keep: str) -> str:
    """Chunks that end at separators, of a table with a text column."""
    from .operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, CHUNK_SLACK

    step = CHUNK_SIZE - CHUNK_OVERLAP - CHUNK_SLACK

    def cut(grid: str) -> str:
        back = f"reverse(substring(text, CAST({grid} - {CHUNK_SLACK} + 1 AS BIGINT), {CHUNK_SLACK}))"
        arms = " ".join(f"WHEN instr({back}, {sep}) > 0 THEN {grid} - instr({back}, {sep}) + 1"
                        for sep in ("chr(10) || chr(10)", "chr(10)", "' '"))
        return f"CASE {arms} ELSE {grid} END"

    word = f"instr(substring(text, CAST(b - {CHUNK_OVERLAP} + 1 AS BIGINT), {CHUNK_OVERLAP}), ' ')"
    piece = "trim(substring(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), ' ' || chr(9) || chr(13) || chr(10))"
    return f"""
SELECT {id_col}, CAST(g // {step} + 1 AS INTEGER) AS chunk_no, piece AS text{keep} FROM (
  SELECT *, {piece} AS piece FROM (
    SELECT *, CASE WHEN g = 0 THEN 0 ELSE b - {CHUNK_OVERLAP} + {word} END AS s FROM (
      SELECT *, CASE WHEN g = 0 THEN 0 ELSE {cut('g')} END AS b,
             CASE WHEN g + {step} >= length(text) THEN length(text) ELSE {cut(f'(g + {step})')} END AS e FROM (
        SELECT *, unnest(range(0, greatest(length(text) - 1, 0) + 1, {step})) AS g FROM {table} WHERE text IS NOT NULL) x0) x1) x2) x3
WHERE piece <> ''"""


def _recursive_chunks_sql(table: str, id_col: str, keep: str) -> str:
    """Chunks by recursive splitting, of a table with a text column. Each level
    splits what the one before left too long; runs of short parts are walked
    from piece to piece over pointers found by nearest-value joins."""
    from .operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, WHITE_SPACE

    seps = ["chr(10) || chr(10)", "chr(10)", "' '", "''"]
    ctes = [f"src AS (SELECT row_number() OVER () AS rid, * FROM {table} WHERE text IS NOT NULL)", "big0 AS (SELECT rid, CAST(0 AS BIGINT) AS a, text AS piece FROM src)"]
    for k, sep in enumerate(seps):
        here, none = ("TRUE", "FALSE") if sep == "''" else (f"instr(piece, {sep}) > 0", f"instr(piece, {sep}) = 0")
        ctes.append(f"""
cut{k} AS (SELECT rid, a AS parent, n, a + CAST(sum(len) OVER w AS BIGINT) - len AS a, CAST(len AS BIGINT) AS len, part FROM (
  SELECT rid, a, n, CASE WHEN n = 1 THEN s ELSE {sep} || s END AS part, length(s) + CASE WHEN n = 1 THEN 0 ELSE length({sep}) END AS len FROM (
    SELECT rid, a, unnest(range(1, len(ps) + 1)) AS n, unnest(ps) AS s FROM (SELECT rid, a, string_split(piece, {sep}) AS ps FROM big{k} WHERE {here}) p0) p1) p2
  WHERE len > 0 WINDOW w AS (PARTITION BY rid, a ORDER BY n)),
small{k} AS (SELECT rid, {k} AS lvl, parent, count(*) FILTER (len >= {CHUNK_SIZE}) OVER (PARTITION BY rid, parent ORDER BY n) AS run, a, a + len AS z, len FROM cut{k})""")
        if k < 3:
            ctes.append(f"big{k + 1} AS (SELECT rid, a, part AS piece FROM cut{k} WHERE len >= {CHUNK_SIZE} UNION ALL SELECT rid, a, piece FROM big{k} WHERE {none})")
    parts = " UNION ALL ".join(f"SELECT rid || '/' || lvl || '/' || parent || '/' || run AS run, rid, a, z FROM small{k} WHERE len < {CHUNK_SIZE}" for k in range(4))
    white = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
    return f"""
WITH RECURSIVE {', '.join(ctes)},
part AS (SELECT *, lead(z) OVER (PARTITION BY run ORDER BY a) AS nz FROM ({parts}) u),
reach AS (SELECT x.run, x.rid, x.a, y.z, y.nz FROM (SELECT *, a + {CHUNK_SIZE} AS lim FROM part) x ASOF JOIN part y ON x.run = y.run AND x.lim >= y.z),
hop AS (SELECT x.*, y.a AS na FROM (SELECT *, greatest(z - {CHUNK_OVERLAP}, nz - {CHUNK_SIZE}) AS lim FROM reach) x ASOF LEFT JOIN part y ON x.run = y.run AND x.lim <= y.a),
walk AS (SELECT run, min(a) AS a FROM part GROUP BY run UNION ALL SELECT h.run, h.na FROM walk w JOIN hop h ON w.run = h.run AND w.a = h.a WHERE h.nz IS NOT NULL),
cutout AS (SELECT h.rid, h.a, trim(substring(s.text, CAST(h.a + 1 AS BIGINT), CAST(h.z - h.a AS BIGINT)), {white}) AS piece
  FROM walk w JOIN hop h ON w.run = h.run AND w.a = h.a JOIN src s ON s.rid = h.rid)
SELECT s.{id_col}, CAST(row_number() OVER (PARTITION BY c.rid ORDER BY c.a) AS INTEGER) AS chunk_no, piece AS text{keep}
FROM cutout c JOIN src s ON c.rid = s.rid WHERE piece <> ''"""


def _documents_sql() -> tuple[str, str]:
    """Review documents and feature documents."""
    from .plans.text import FEATURE_FIELDS

    feat = " || ', ' || ".join(
        f"'{label}: ' || CAST(COALESCE(r.{col}, 0.0) AS VARCHAR)" for label, col in FEATURE_FIELDS)
    review_docs = ("SELECT r.review_id, r.hotel_id, 'Hotel: ' || COALESCE(CAST(h.hotel_name AS VARCHAR), 'nan') || "
                   "'. Review: ' || COALESCE(CAST(r.review_text AS VARCHAR), 'nan') AS text "
                   "FROM reviews r LEFT JOIN hotels h ON r.hotel_id = h.hotel_id")
    feature_docs = ("SELECT r.review_id, r.hotel_id, 'Hotel: ' || COALESCE(h.hotel_name, 'Unknown Hotel') || ' (ID: ' || "
                    f"COALESCE(CAST(r.hotel_id AS VARCHAR), 'nan') || '). ' || {feat} || '.' AS text "
                    "FROM reviews r LEFT JOIN hotels h ON r.hotel_id = h.hotel_id")
    return review_docs, feature_docs


def _neighbours_sql(review_docs: str, feature_docs: str) -> str:
    """CTEs text_lines and feature_lines (question_id, pos, text). Only documents
    that share a token, and the k first by key (all others score 0 as they do),
    can be among the k best."""
    from .operators.vectors import TOKEN_SPLIT
    from .plans.context import FEATURE_K, TEXT_K

    def search(name: str, docs: str, k: int) -> str:
        chunks = _recursive_chunks_sql(f"({docs}) docs", "review_id", ", hotel_id")
        def split(text: str) -> str:
            return f"unnest(regexp_split_to_array(lower({text}), '{TOKEN_SPLIT}')) AS token"

        return f"""
{name}_docs AS (SELECT *, COALESCE(review_id, '') || '#' || lpad(CAST(chunk_no AS VARCHAR), 10, '0') || '#' || sha256(text) AS id
  FROM ({chunks}) c),
{name}_df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT rid, token FROM (
  SELECT rid, {split('text')} FROM (SELECT row_number() OVER () AS rid, text FROM {name}_docs) z) y) x WHERE token <> '' GROUP BY token),
{name}_idf AS (SELECT token, ln(((SELECT count(*) FROM {name}_docs) + 1) / (df + 1)) + 1 AS idf FROM {name}_df),
{name}_one AS (SELECT id, any_value(text) AS text, any_value(CAST(hotel_id AS VARCHAR)) AS key FROM {name}_docs GROUP BY id),
{name}_dw AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (
  SELECT t.id, t.token, count(*) * any_value(idf) AS w FROM (SELECT id, {split('text')} FROM {name}_one) t
  JOIN {name}_idf i ON t.token = i.token GROUP BY t.id, t.token) x),
{name}_qw AS (SELECT q, token, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS w FROM (
  SELECT t.q, t.token, count(*) * any_value(idf) AS w FROM (SELECT q, {split('q')} FROM qtexts) t
  JOIN {name}_idf i ON t.token = i.token GROUP BY t.q, t.token) x),
{name}_hits AS (SELECT q, id, round(sum(a.w * b.w), 6) AS score FROM {name}_qw a JOIN {name}_dw b ON a.token = b.token GROUP BY q, id),
{name}_cand AS (SELECT * FROM {name}_hits UNION ALL
  SELECT q, id, 0.0 FROM qtexts, (SELECT id FROM {name}_one ORDER BY id LIMIT {k}) f
  WHERE (q, id) NOT IN (SELECT (q, id) FROM {name}_hits)),
{name}_nn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS p FROM {name}_cand QUALIFY p <= {k}),"""

    return f"""
WITH qtexts AS (SELECT DISTINCT COALESCE(user_query, '') AS q FROM questions),
{search('text', review_docs, TEXT_K)}
{search('feature', feature_docs, FEATURE_K)}
text_lines AS (SELECT question_id, CAST(p AS INTEGER) AS pos, d.text FROM questions u JOIN text_nn n ON COALESCE(u.user_query, '') = n.q
  JOIN text_one d ON n.id = d.id),
feature_kept AS (SELECT n.*, d.text, d.key FROM feature_nn n JOIN feature_one d ON n.id = d.id
  QUALIFY d.key IS NULL OR row_number() OVER (PARTITION BY q, d.key ORDER BY p) = 1),
feature_lines AS (SELECT question_id, pos, text FROM questions u JOIN (
  SELECT q, text, CAST(row_number() OVER (PARTITION BY q ORDER BY p) AS INTEGER) AS pos FROM feature_kept) n ON COALESCE(u.user_query, '') = n.q)
"""


def _approximate_sql(k: int) -> str:
    """The buckets and probes of the first round by their rules, exact scores of
    the pairs that meet, and all pairs of the rows that meet too few."""
    from .operators.approx import BUCKET_ROWS, MOST_BITS, PROBES, TABLES

    x = "((t * 7919 + b * 104729 + d * 1299709 + 12345) % 2147483647)"
    steps = "".join(f", r{j} AS (SELECT t, b, d, (x * x + 48271 * x + 11) % 2147483647 AS x FROM r{j - 1})" for j in (1, 2, 3))
    return f"""
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT count(*) AS n, greatest(1, least({MOST_BITS}, ceil(log2(greatest(count(*), 1) / {BUCKET_ROWS})))) AS bits, max(len(v)) AS dims FROM e),
r0 AS (SELECT t, b, d, {x} AS x FROM (SELECT unnest(range(0, {TABLES})) AS t) tt, (SELECT unnest(range(0, CAST(bits AS BIGINT))) AS b FROM n) bb,
  (SELECT unnest(range(0, dims)) AS d FROM n) dd){steps},
plane AS (SELECT t, b, list(CASE WHEN (x >> 16) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY d) AS p FROM r3 GROUP BY t, b),
m AS (SELECT id, t, b, list_dot_product(v, p) AS m FROM e, plane),
own AS (SELECT id, t, CAST(sum(CASE WHEN m > 0 THEN 1 << b ELSE 0 END) AS BIGINT) AS own FROM m GROUP BY id, t),
weak AS (SELECT id, t, b FROM m QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY abs(m), b) <= {PROBES - 1}),
probe AS (SELECT id, t, own FROM own UNION ALL SELECT o.id, o.t, xor(o.own, 1 << w.b) FROM own o JOIN weak w ON o.id = w.id AND o.t = w.t),
met AS (SELECT DISTINCT q.id AS query_id, o.id AS neighbor_id FROM probe q JOIN own o ON q.t = o.t AND q.own = o.own),
short AS (SELECT e.id FROM e LEFT JOIN met ON e.id = query_id GROUP BY e.id HAVING count(neighbor_id) < (SELECT least({k}, n) FROM n)),
pair AS (SELECT * FROM met WHERE query_id NOT IN (SELECT id FROM short) UNION ALL SELECT s.id, e.id FROM short s, e),
scored AS (SELECT query_id, neighbor_id, list_cosine_similarity(a.v, b.v) AS score FROM pair JOIN e a ON a.id = query_id JOIN e b ON b.id = neighbor_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS pos, neighbor_id, {R('score', 6)} AS score
FROM scored QUALIFY pos <= {k}"""


def _text_sql() -> dict[str, str]:
    from .operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE
    from .operators.vectors import TOKEN_SPLIT
    from .plans.text import SAMPLE_SEED
    step = CHUNK_SIZE - CHUNK_OVERLAP
    e = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
    cos = (f"{e}, nn AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, b.label AS key, "
           "list_cosine_similarity(a.v, b.v) AS score FROM e a, e b) d "
           "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id ASC) <= 10)")
    review_docs, feature_docs = _documents_sql()
    vec = _neighbours_sql(review_docs, feature_docs)
    return {
        "text_topk": f"{vec} SELECT question_id, pos, text FROM text_lines",
        "feature_topk": f"{vec} SELECT question_id, pos, text FROM feature_lines",
        "doc_sample": f"SELECT review_id, hotel_id, text FROM ({review_docs}) d ORDER BY md5('{SAMPLE_SEED}:' || review_id), review_id, text LIMIT 1000",
        "chunk_separators": _separator_chunks_sql("documents", "doc_id", ""),
        "chunk_recursive": f"SELECT * FROM ({_recursive_chunks_sql('documents', 'doc_id', '')}) c",
        "review_docs": "SELECT r.review_id, r.hotel_id, 'Hotel: ' || COALESCE(CAST(h.hotel_name AS VARCHAR), 'nan') || "
                       "'. Review: ' || COALESCE(CAST(r.review_text AS VARCHAR), 'nan') AS text "
                       "FROM reviews r LEFT JOIN hotels h ON r.hotel_id = h.hotel_id",
        "feature_text": feature_docs,
        "chunk_fixed": f"SELECT doc_id, chunk_no, text FROM (SELECT doc_id, CAST((s - 1) // {step} + 1 AS INTEGER) AS chunk_no, "
                       f"substring(text, s, {CHUNK_SIZE}) AS text FROM (SELECT doc_id, text, "
                       f"unnest(range(1, greatest(length(text) - {CHUNK_OVERLAP}, 1) + 1, {step})) AS s "
                       "FROM documents WHERE text IS NOT NULL) x) y WHERE text <> ''",
        "tfidf_weights": f"""
WITH tok AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '{TOKEN_SPLIT}')) AS token FROM documents),
tc AS (SELECT id, token, count(*) AS tf FROM tok WHERE token <> '' GROUP BY id, token),
n AS (SELECT count(*) AS n_docs FROM documents),
idf AS (SELECT token, ln((any_value(n_docs) + 1) / (count(*) + 1)) + 1 AS idf FROM tc, n GROUP BY token),
w AS (SELECT tc.id, tc.token, tc.tf * idf.idf AS w FROM tc JOIN idf ON tc.token = idf.token),
nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id)
SELECT w.id AS doc_id, w.token, {R('w.w / nm.norm', 6)} AS weight FROM w JOIN nm ON w.id = nm.id""",
        "knn_l2": f"{e} SELECT query_id, pos, neighbor_id, {R('score', 6)} AS score FROM (SELECT *, "
                  "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score ASC, neighbor_id ASC) AS INTEGER) AS pos "
                  "FROM (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS score "
                  "FROM e a, e b) d) x WHERE pos <= 3",
        "knn_cosine": f"{e} SELECT query_id, pos, neighbor_id, {R('score', 6)} AS score FROM (SELECT *, "
                      "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id ASC) AS INTEGER) AS pos "
                      "FROM (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_cosine_similarity(a.v, b.v) AS score "
                      "FROM e a, e b) d) x WHERE pos <= 10",
        "knn_approx": _approximate_sql(10),
        "knn_dedup": f"{cos}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id ASC) AS p FROM nn), "
                     "k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY p) = 1 OR key IS NULL) "
                     "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p) AS INTEGER) AS pos, neighbor_id, key FROM k",
        "store_topk": f"{cos}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id ASC) AS p FROM nn), "
                      "k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY p) = 1 OR key IS NULL) "
                      "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p) AS INTEGER) AS pos, neighbor_id, CAST(key AS BIGINT) AS key FROM k",
        "latent_store": "SELECT doc_id, CAST(64 AS INTEGER) AS dims, regexp_matches(COALESCE(text, ''), '[\\p{L}\\p{N}]') AS unit FROM documents",
        "vec_scan": "SELECT vec_id AS doc_id, CAST(label AS BIGINT) AS hotel_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings",
    }


# ----------------------------------------------------------------------------- context (graph-only mode)
def _context_sql() -> dict[str, str]:
    from .plans import context as cx
    from .plans.retrieval import DIMENSIONS
    r = _retrieval_sql()
    num = "COALESCE(CAST({x} AS VARCHAR), 'None')"
    r2 = lambda x: num.format(x=R(x, 2))
    reqs = (f"SELECT DISTINCT {_list_repr('age_groups')} AS groups_key, unnest(age_groups) AS age "
            f"FROM ({_understand_sql()}) u0 WHERE age_groups IS NOT NULL")
    r6 = r["r6_countries_by_age"]
    r7 = r["r7_hotels_by_age"]
    label = "CASE u.sort_by " + " ".join(f"WHEN '{d}' THEN '{v[1]}'" for d, v in DIMENSIONS.items()) + " END"
    best_parts = []
    for num_, dim in zip((8, 9, 10, 11), DIMENSIONS):
        display = DIMENSIONS[dim][2]
        for scope in ("global", "city", "country"):
            best_parts.append(
                f"SELECT '{dim}' AS sort_by, '{scope}' AS scope, COALESCE(scope_key, '') AS scope_key, pos, "
                f"'Hotel: ' || Hotel || ' ({display}: ' || {r2('AvgScore')} || ')' AS line "
                f"FROM ({r[f'r{num_}_{dim.lower()}_{scope}']}) b{num_}{scope}")
    msg = "CASE u.sort_by " + " ".join(
        f"WHEN '{d}' THEN replace('{v[3]}', '{{scope}}', CASE WHEN u.city IS NOT NULL THEN 'in ' || u.city "
        "WHEN u.country IS NOT NULL THEN 'in ' || u.country ELSE 'Globally' END)"
        for d, v in DIMENSIONS.items()) + " END"
    lst = _list_repr("u.age_groups")
    base = f"""
WITH u AS ({_understand_sql()}),
r1 AS ({r['r1_hotels_by_city']}), r2 AS ({r['r2_hotels_by_country']}), r3 AS ({r['r3_hotels_by_type']}),
r4 AS ({r['r4_countries_by_type']}), r5 AS ({r['r5_countries_by_gender']}), r6 AS ({r6}), r7 AS ({r7}),
best AS ({' UNION ALL '.join(best_parts)}),
su AS (SELECT u.*, CASE WHEN city IS NOT NULL THEN 'city' WHEN country IS NOT NULL THEN 'country' ELSE 'global' END AS scope,
              COALESCE(lower(city), lower(country), '') AS scope_key FROM u WHERE sort_by IS NOT NULL),
found AS (SELECT su.question_id, 6 AS seq, best.pos, best.line FROM su JOIN best
          ON su.sort_by = best.sort_by AND su.scope = best.scope AND su.scope_key = best.scope_key),
lines AS (
  SELECT u.question_id, 1 AS seq, r1.pos, 'Hotel: ' || r1.Hotel || ' (Rating: ' || {num.format(x='r1.Score')} || ')' AS line
    FROM u JOIN r1 ON lower(u.city) = r1.city_key
  UNION ALL SELECT u.question_id, 2, r2.pos, 'Hotel: ' || r2.Hotel || ' (Rating: ' || {num.format(x='r2.Score')} || ')'
    FROM u JOIN r2 ON lower(u.country) = r2.country_key
  UNION ALL SELECT u.question_id, 3, r4.pos, 'Country: ' || r4.Country || ' (Avg Rating: ' || {r2('r4.avgRating')} || ')'
    FROM u JOIN r4 ON lower(u.traveller_type) = r4.type_key WHERE u.country_mode
  UNION ALL SELECT u.question_id, 3, r3.pos, 'Hotel: ' || r3.hotelName || ' (Avg Rating: ' || {r2('r3.avgRating')} || ')'
    FROM u JOIN r3 ON lower(u.traveller_type) = r3.type_key WHERE NOT u.country_mode
  UNION ALL SELECT u.question_id, 4, r5.pos, 'Country: ' || r5.Country || ' (' || CAST(r5.Visits AS VARCHAR) || ' visits)'
    FROM u JOIN r5 ON lower(u.gender) = r5.gender_key
  UNION ALL SELECT u.question_id, 5, r6.pos, 'Country: ' || r6.Country || ' (' || CAST(r6.Visits AS VARCHAR) || ' visits)'
    FROM u JOIN r6 ON {lst} = r6.groups_key WHERE u.country_mode AND u.age_groups IS NOT NULL
  UNION ALL SELECT u.question_id, 5, r7.pos, 'Hotel: ' || r7.Hotel || ' (Avg Rating: ' || {r2('r7.avgRating')} || ')'
    FROM u JOIN r7 ON {lst} = r7.groups_key WHERE NOT u.country_mode AND u.age_groups IS NOT NULL
  UNION ALL SELECT * FROM found
  UNION ALL SELECT u.question_id, 6, 1, {msg} FROM su u WHERE u.question_id NOT IN (SELECT question_id FROM found)),
heads AS (
  SELECT question_id, 1 AS seq, 'Top Hotels in ' || city || ' (from KG):' AS header FROM u WHERE city IS NOT NULL
  UNION ALL SELECT question_id, 2, 'Top Hotels in ' || country || ' (from KG):' FROM u WHERE country IS NOT NULL
  UNION ALL SELECT question_id, 3, CASE WHEN country_mode THEN 'Top Rated Countries for ''' || traveller_type || ''':'
                                        ELSE 'Top Hotels for ''' || traveller_type || ''':' END FROM u WHERE traveller_type IS NOT NULL
  UNION ALL SELECT question_id, 4, 'Popular for ' || gender || ':' FROM u WHERE gender IS NOT NULL
  UNION ALL SELECT question_id, 5, CASE WHEN country_mode THEN 'Popular Countries for Ages ' ELSE 'Top Rated Hotels for Ages ' END
                                   || {lst} || ':' FROM u WHERE age_groups IS NOT NULL
  UNION ALL SELECT question_id, 6, {label} || ' Hotels (' || COALESCE(city, country, 'Global') || '):' FROM u WHERE sort_by IS NOT NULL),
body AS (SELECT question_id, seq, string_agg(line, chr(10) ORDER BY pos) AS body FROM lines GROUP BY question_id, seq),
secs AS (SELECT h.question_id, h.seq, h.header || chr(10) || COALESCE(b.body, '') AS section
         FROM heads h LEFT JOIN body b ON h.question_id = b.question_id AND h.seq = b.seq
         WHERE b.body IS NOT NULL OR h.seq = 6)"""

    def ctx(secs: str) -> str:
        return f""",
ctx AS (SELECT q.question_id, COALESCE(NULLIF(string_agg(s.section, chr(10) || chr(10) ORDER BY s.seq), ''), '{cx.NO_CONTEXT}') AS context
        FROM questions q LEFT JOIN ({secs}) s ON q.question_id = s.question_id GROUP BY q.question_id)
"""

    vec_secs = " UNION ALL ".join(
        f"SELECT q.question_id, {seq} AS seq, '{header}' || chr(10) || COALESCE(string_agg(l.text, chr(10) ORDER BY l.pos), '') AS section "
        f"FROM questions q LEFT JOIN {lines} l ON q.question_id = l.question_id GROUP BY q.question_id"
        for seq, header, lines in ((7, cx.TEXT_HEADER, "text_lines"), (8, cx.FEATURE_HEADER, "feature_lines")))
    near = _neighbours_sql(*_documents_sql()).rstrip()
    graph_ctx, vector_ctx = base + ctx("SELECT * FROM secs"), near + ctx(vec_secs)
    hybrid_ctx = near + "," + base.strip().removeprefix("WITH") + ctx(f"SELECT question_id, seq, section FROM secs UNION ALL {vec_secs}")
    ind = "    "
    ents = ("COALESCE(NULLIF(concat_ws(', ', "
            "CASE WHEN city IS NOT NULL THEN 'City: ' || city END, "
            "CASE WHEN country IS NOT NULL THEN 'Country: ' || country END, "
            "CASE WHEN hotel IS NOT NULL THEN 'Hotel: ' || hotel END, "
            "CASE WHEN traveller_type IS NOT NULL THEN 'Traveller Type: ' || traveller_type END, "
            "CASE WHEN gender IS NOT NULL THEN 'Gender: ' || gender END, "
            f"CASE WHEN age_groups IS NOT NULL THEN 'Target Age Groups: ' || {lst} END, "
            "CASE WHEN sort_by IS NOT NULL THEN 'Sort By: ' || sort_by END), ''), 'None')")
    nl = "chr(10)"
    prompt = (f"{nl} || '{ind}You are a Hotel Recommender.' || {nl} || '{ind}RETRIEVAL MODE: ' || '@mode' || {nl} || "
              f"'{ind}DETECTED ENTITIES: ' || {ents} || {nl} || '{ind}CONTEXT:' || {nl} || '{ind}' || ctx.context || {nl} || "
              f"'{ind}USER QUESTION: ' || COALESCE(u.user_query, '') || {nl} || '{ind}Answer:' || {nl} || '{ind}'")
    loc = "COALESCE(city, country, 'Global')"
    qlog = f"""
WITH u AS ({_understand_sql()})
SELECT question_id, 1 AS seq, 'City Search (' || city || ')' AS intent, 'hotels_by_city' AS query_name FROM u WHERE city IS NOT NULL
UNION ALL SELECT question_id, 2, 'Country Search (' || country || ')', 'hotels_by_country' FROM u WHERE country IS NOT NULL
UNION ALL SELECT question_id, 3, CASE WHEN country_mode THEN 'Country by Traveller Type (' ELSE 'Hotel by Traveller Type (' END
                 || traveller_type || ')', CASE WHEN country_mode THEN 'best_countries_by_traveller_type' ELSE 'hotels_by_traveller_type' END
          FROM u WHERE traveller_type IS NOT NULL
UNION ALL SELECT question_id, 4, 'Gender Demographics (' || gender || ')', 'top_countries_by_gender' FROM u WHERE gender IS NOT NULL
UNION ALL SELECT question_id, 5, CASE WHEN country_mode THEN 'Country by Age Group (' ELSE 'Hotel by Age Group (' END
                 || {lst} || ')', CASE WHEN country_mode THEN 'top_countries_by_age_groups' ELSE 'top_hotels_by_age_groups' END
          FROM u WHERE age_groups IS NOT NULL
UNION ALL SELECT question_id, 6, 'Sort by ' || {label} || ' (' || {loc} || ')', 'best_hotels_by_' || lower(sort_by)
          FROM u WHERE sort_by IS NOT NULL"""
    return {
        "context_sections": base + "\nSELECT question_id, seq, section FROM secs",
        "context_full": graph_ctx + "SELECT question_id, context FROM ctx",
        "context_full_vector": vector_ctx + "SELECT question_id, context FROM ctx",
        "context_full_hybrid": hybrid_ctx + "SELECT question_id, context FROM ctx",
        "prompts": graph_ctx + f"SELECT u.question_id, {prompt} AS prompt FROM u JOIN ctx ON u.question_id = ctx.question_id".replace("@mode", cx.BASELINE),
        "prompts_hybrid": hybrid_ctx + f"SELECT u.question_id, {prompt} AS prompt FROM u JOIN ctx ON u.question_id = ctx.question_id".replace("@mode", cx.HYBRID),
        "query_log": qlog,
    }
