"""Fixture views over the driver's TPC-H-like tables.

The five travel tables (hotels, users, reviews, visa, questions) are derived
from nation / supplier / customer / orders / lineitem / part with SQL that runs
unchanged in Spark SQL and DuckDB, so the engine and its oracle share one text.
Placeholders ``{lineitem}`` etc. become DataFrame arguments of ``spark.sql`` on
the Spark side and plain view names on the DuckDB side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Every source repeats some keys with other values; _ord says which row is the last.
HOTELS_SQL = """
SELECT s_suppkey AS hotel_id, s_name || d.suffix AS hotel_name,
       n_name || '_C' || CAST(s_suppkey % 3 AS STRING) AS city, n_name AS country,
       CAST(1 + (s_suppkey + d._ord) % 5 AS INT) AS star_rating,
       CAST(70 + (s_suppkey * 7 + d._ord)  % 30 AS DOUBLE) / 10 AS cleanliness_base,
       CAST(70 + (s_suppkey * 11) % 30 AS DOUBLE) / 10 AS comfort_base,
       CAST(70 + (s_suppkey * 13) % 30 AS DOUBLE) / 10 AS facilities_base, d._ord
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
JOIN (SELECT CAST(1 AS BIGINT) AS _ord, '' AS suffix UNION ALL SELECT CAST(0 AS BIGINT), ' Old' UNION ALL SELECT CAST(2 AS BIGINT), ' New') d
  ON d._ord = 1 OR (d._ord = 0 AND s_suppkey % 7 = 0) OR (d._ord = 2 AND s_suppkey % 11 = 0)
UNION ALL
SELECT CAST(1000000 + n_nationkey AS BIGINT), 'Empty ' || n_name, n_name || '_C0', n_name, CAST(3 AS INT),
       CAST(8 AS DOUBLE), CAST(8 AS DOUBLE), CAST(8 AS DOUBLE), CAST(1 AS BIGINT)
FROM {nation} WHERE n_nationkey < 2
"""

USERS_SQL = """
SELECT c_custkey AS user_id, CASE WHEN (c_custkey + d._ord) % 2 = 1 THEN 'Female' ELSE 'Male' END AS user_gender, n_name AS country,
       CASE CAST(floor(c_custkey / 2) + d._ord - 1 AS BIGINT) % 5 WHEN 0 THEN '18-24' WHEN 1 THEN '25-34' WHEN 2 THEN '35-44'
            WHEN 3 THEN '45-54' ELSE '55+' END AS age_group,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Business' WHEN 'BUILDING' THEN 'Couple' WHEN 'FURNITURE' THEN 'Family'
            WHEN 'HOUSEHOLD' THEN 'Solo' ELSE 'Group' END AS traveller_type, d._ord
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
JOIN (SELECT CAST(1 AS BIGINT) AS _ord UNION ALL SELECT CAST(2 AS BIGINT)) d ON d._ord = 1 OR c_custkey % 13 = 0
"""

# A repeated review has another writer, text and scores; some reviews name no hotel, some are long.
REVIEWS_SQL = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' ||
       CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS INT) AS STRING) AS review_id,
       CASE WHEN l_partkey % 211 = 0 THEN CAST(-1 AS BIGINT) WHEN d._ord = 1 THEN o_custkey
            WHEN o_custkey > 1 THEN o_custkey - 1 ELSE o_custkey + 1 END AS user_id,
       CASE WHEN l_partkey % 31 = 0 THEN CAST(NULL AS BIGINT) ELSE l_suppkey END AS hotel_id,
       CAST(CAST(l_shipdate AS DATE) AS STRING) AS review_date,
       CASE WHEN d._ord = 2 THEN 'Second look: ' ELSE '' END ||
         CASE WHEN l_partkey % 37 = 0 THEN repeat(p_name || '. ', 60) ELSE p_name || ' ' END || l_returnflag AS review_text,
       CAST(50 + (l_partkey + CAST(l_quantity AS INT) * d._ord) % 51 AS DOUBLE) / 10 AS score_overall,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(50 + (l_partkey * 3 + l_linenumber * d._ord) % 51 AS DOUBLE) / 10 END AS score_cleanliness,
       CAST(50 + (l_partkey * 7  + l_linenumber) % 51 AS DOUBLE) / 10 AS score_comfort,
       CAST(50 + (l_partkey * 11 + l_linenumber) % 51 AS DOUBLE) / 10 AS score_facilities,
       CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(50 + (l_partkey * 13 + CAST(l_quantity AS INT)) % 51 AS DOUBLE) / 10 END AS score_location,
       CAST(50 + (l_partkey * 5  + l_linenumber) % 51 AS DOUBLE) / 10 AS score_staff,
       CAST(50 + (l_partkey * 2  + CAST(l_quantity AS INT)) % 51 AS DOUBLE) / 10 AS score_value_for_money, d._ord
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
JOIN (SELECT CAST(1 AS BIGINT) AS _ord UNION ALL SELECT CAST(2 AS BIGINT)) d ON d._ord = 1 OR l_partkey % 29 = 0
"""

VISA_SQL = """
SELECT a.n_name AS from_country, b.n_name AS to_country,
       CASE WHEN (a.n_nationkey * 7 + b.n_nationkey * 3) % 10 < 3 THEN 'Yes' ELSE 'No' END AS requires_visa,
       CASE WHEN (a.n_nationkey * 7 + b.n_nationkey * 3) % 10 = 0 THEN 'Tourist Visa'
            WHEN (a.n_nationkey * 7 + b.n_nationkey * 3) % 10 < 3 THEN 'Tourist Visa / eVisa' ELSE 'Visa-Free / eVisa' END AS visa_type
FROM {nation} a JOIN {nation} b ON a.n_nationkey <> b.n_nationkey AND b.n_nationkey < 20
"""

# One question per customer, so the question batch grows with the data; most texts are distinct.
QUESTIONS_SQL = """
SELECT c_custkey AS question_id, CASE c_custkey % 8
  WHEN 0 THEN 'Find hotels in ' || n_name || '_C' || CAST(c_custkey % 3 AS STRING) || '.'
  WHEN 1 THEN 'Best hotels in ' || n_name || ' for solo travellers that are clean and comfortable.'
  WHEN 2 THEN 'Which countries do people aged 25-34 usually visit?'
  WHEN 3 THEN 'Cleanest hotels in ' || lower(n_name) || '_c1'
  WHEN 4 THEN 'Which country suits Business guests?'
  WHEN 5 THEN 'What do female guests between 18 and 40 like?'
  WHEN 6 THEN 'Hotels with a central location, good value'
  ELSE 'Tell me a story' END || CASE WHEN c_custkey % 5 < 4 THEN ' Request ' || CAST(c_custkey AS STRING) ELSE '' END AS user_query
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

FIXTURE_SQL = {
    "hotels": HOTELS_SQL,
    "users": USERS_SQL,
    "reviews": REVIEWS_SQL,
    "visa": VISA_SQL,
    "questions": QUESTIONS_SQL,
}

_NEEDS = {
    "hotels": ("supplier", "nation"),
    "users": ("customer", "nation"),
    "reviews": ("lineitem", "orders", "part"),
    "visa": ("nation",),
    "questions": ("customer", "nation"),
}


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a Spark DataFrame (lazy; nothing is collected)."""
    args = {t: read_driver_table(spark, sf_dir, t) for t in _NEEDS[name]}
    return spark.sql(FIXTURE_SQL[name], **args)


def fixture_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: fixture_table(spark, sf_dir, name) for name in FIXTURE_SQL}


def duckdb_fixture_ctes() -> str:
    """The same views as a DuckDB ``WITH`` list (without the keyword)."""
    plain = {t: t for t in DRIVER_TABLES}
    return ",\n".join(f"{name} AS ({sql.format(**plain)})" for name, sql in FIXTURE_SQL.items())
