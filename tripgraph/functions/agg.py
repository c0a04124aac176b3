"""Aggregate and rounding helpers shared by every query.

Averages are computed from an exact decimal sum and a count, so the answer
does not depend on partitioning or row order, and partial (sum, count) pairs
can be merged exactly across levels (review -> hotel -> hotel name).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUM_TYPE = "decimal(18,6)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum_count(c, name: str) -> list[Column]:
    """Partial state of an exact average: ``<name>_sum`` and ``<name>_n``."""
    c = _c(c)
    return [F.sum(c.cast(SUM_TYPE)).alias(f"{name}_sum"), F.count(c).alias(f"{name}_n")]


def merge_sum_count(name: str) -> list[Column]:
    """Combine partial states produced by :func:`sum_count`."""
    return [F.sum(f"{name}_sum").alias(f"{name}_sum"), F.sum(f"{name}_n").alias(f"{name}_n")]


def avg_of(name: str) -> Column:
    """Finish an exact average from its partial state; NULL when the count is 0."""
    return F.try_divide(F.col(f"{name}_sum").cast("double"), F.col(f"{name}_n"))


def exact_avg(c) -> Column:
    """One-level exact average (skips NULL like SQL AVG)."""
    c = _c(c)
    return F.try_divide(F.sum(c.cast(SUM_TYPE)).cast("double"), F.count(c))


def round_dec(c, digits: int) -> Column:
    """Half-up rounding on the decimal value, identical in Spark and DuckDB."""
    return F.round(_c(c).try_cast("decimal(38,10)"), digits).cast("double")


# SQL text of the same helpers, for the DuckDB oracles.
def sql_avg(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,6))) AS DOUBLE) / NULLIF(COUNT({x}), 0)"


def sql_round(x: str, digits: int) -> str:
    return f"CAST(ROUND(TRY_CAST({x} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"
