"""Fixed word lists, patterns and labels of question understanding, and the
column expressions built on them. All expressions are native Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Age-group labels and their inclusive bounds (55+ is 55..100), in this order.
AGE_GROUPS = [
    ("18-24", 18, 24),
    ("25-34", 25, 34),
    ("35-44", 35, 44),
    ("45-54", 45, 54),
    ("55+", 55, 100),
]

# Age-range pattern, matched on the lower-cased question.
AGE_PATTERN = r"(?:between\s+)?(\d+)\s*(?:to|and|-)\s*(\d+)"

# Sort-intent keyword lists, in checking order; a later list
# overrides an earlier one.
SORT_KEYWORDS = [
    ("Cleanliness", ["cleanliness", "clean", "hygiene", "tidy"]),
    ("Value", ["value", "money", "worth", "price"]),
    ("Location", ["location", "central", "convenient"]),
    ("Comfort", ["comfort", "comfortable", "cozy"]),
]

# Words that switch type / age questions to country answers.
COUNTRY_MODE_WORDS = ["country", "countries"]

# The category that is in the dictionary but not linked by substring.
AGE_CATEGORY = "Age Group"


def contains_any(text_lc: Column, words: list[str]) -> Column:
    cond = None
    for w in words:
        c = text_lc.contains(F.lit(w))
        cond = c if cond is None else cond | c
    return cond


def sort_intent(text_lc: Column) -> Column:
    """The last keyword list that matches wins."""
    expr = None
    for label, words in reversed(SORT_KEYWORDS):
        expr = (F.when(contains_any(text_lc, words), F.lit(label)) if expr is None
                else expr.when(contains_any(text_lc, words), F.lit(label)))
    return expr


def age_bounds(text_lc: Column) -> tuple[Column, Column]:
    """(min, max) of the first age range in the text; NULL when there is none."""
    hit = F.regexp_extract(text_lc, AGE_PATTERN, 0) != ""
    lo = F.when(hit, F.regexp_extract(text_lc, AGE_PATTERN, 1).try_cast("bigint"))
    hi = F.when(hit, F.regexp_extract(text_lc, AGE_PATTERN, 2).try_cast("bigint"))
    return lo, hi


def written(df, name: str):
    """Write ``df`` to the shared checkpoint folder and read it back (cuts lineage
    for a table that several later plans read)."""
    from ..session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def age_groups(lo: Column, hi: Column) -> Column:
    """Labels of the groups that overlap [lo, hi], in table order; empty array
    when none; NULL without a range (greatest/least would skip a NULL bound)."""
    labels = [
        F.when(F.greatest(lo, F.lit(g_lo)) <= F.least(hi, F.lit(g_hi)), F.lit(label))
        for label, g_lo, g_hi in AGE_GROUPS
    ]
    return F.when(lo.isNotNull() & hi.isNotNull(), F.filter(F.array(*labels), lambda x: x.isNotNull()))


def py_list_repr(arr: Column) -> Column:
    """How a list of strings prints in the reference's messages: ['a', 'b']."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


# SQL text of the same expressions, for the DuckDB oracles.
def sql_sort_intent(x: str) -> str:
    arms = " ".join(
        f"WHEN {' OR '.join(f'contains({x}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{label}'"
        for label, words in reversed(SORT_KEYWORDS)
    )
    return f"CASE {arms} END"


def sql_age_groups(lo: str, hi: str) -> str:
    arms = ", ".join(
        f"CASE WHEN greatest({lo}, {g_lo}) <= least({hi}, {g_hi}) THEN '{label}' END" for label, g_lo, g_hi in AGE_GROUPS
    )
    return f"CASE WHEN {lo} IS NOT NULL AND {hi} IS NOT NULL THEN list_filter([{arms}], lambda x: x IS NOT NULL) END"
