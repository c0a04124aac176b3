"""Broadcast only behind a size check.

``checked_broadcast`` counts at most ``max_rows + 1`` rows (a limit scan that
stops early) and hints a broadcast only when the side is proven small; beyond
the bound the frame is returned unhinted and the join shuffles (AQE may still
turn it into a broadcast from runtime statistics under
``spark.sql.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows that a broadcast side may hold (a few MB for narrow dimension rows).
DEFAULT_MAX_ROWS = 200_000


def is_small(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    return F.broadcast(df) if is_small(df, max_rows) else df
