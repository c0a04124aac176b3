"""Explicit schemas of the four source tables and the questions table.
Nothing is ever read with schema inference."""

from pyspark.sql import types as T

HOTELS = T.StructType([
    T.StructField("hotel_id", T.LongType()),
    T.StructField("hotel_name", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("star_rating", T.IntegerType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("cleanliness_base", T.DoubleType()),
    T.StructField("comfort_base", T.DoubleType()),
    T.StructField("facilities_base", T.DoubleType()),
    T.StructField("location_base", T.DoubleType()),
    T.StructField("staff_base", T.DoubleType()),
    T.StructField("value_for_money_base", T.DoubleType()),
])

USERS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("user_gender", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("age_group", T.StringType()),
    T.StructField("traveller_type", T.StringType()),
])

SCORE_COLUMNS = (
    "score_overall", "score_cleanliness", "score_comfort", "score_facilities",
    "score_location", "score_staff", "score_value_for_money",
)

REVIEWS = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("hotel_id", T.LongType()),
        T.StructField("review_date", T.StringType()),
        T.StructField("review_text", T.StringType()),
    ]
    + [T.StructField(c, T.DoubleType()) for c in SCORE_COLUMNS]
)

# The CSV header names the pair `from`,`to`; our tables call them from_country, to_country.
VISA = T.StructType([
    T.StructField("from_country", T.StringType()),
    T.StructField("to_country", T.StringType()),
    T.StructField("requires_visa", T.StringType()),
    T.StructField("visa_type", T.StringType()),
])

QUESTIONS = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("user_query", T.StringType()),
])

SOURCES = {"hotels": HOTELS, "users": USERS, "reviews": REVIEWS, "visa": VISA}
