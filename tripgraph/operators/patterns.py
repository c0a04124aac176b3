"""Path-pattern building blocks over the graph tables.

A Cypher pattern such as ``(t:Traveller)-[:WROTE]->(r:Review)-[:REVIEWED]->(h:Hotel)``
with an aggregate over ``r`` becomes: filter the pre-aggregated per-segment
states, merge them per hotel, then join hotel names (or places) and merge again.
Every level carries exact (sum, count) states, so grouping by hotel node or by
hotel name gives the same averages as one flat aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.agg import merge_sum_count
from .graph import Graph


def segment_states(g: Graph, where: Column | None, metrics: list[str], extra_keys: list[str] = ()) -> DataFrame:
    """Per-hotel (sum, count) states of ``metrics`` over traveller paths that pass ``where``.

    ``paths`` (number of Traveller-Review-Hotel paths) is always kept.
    """
    df = g.segment_stats if where is None else g.segment_stats.where(where)
    aggs = [F.sum("paths").alias("paths")] + [c for m in metrics for c in merge_sum_count(m)]
    return df.groupBy("hotel_id", *extra_keys).agg(*aggs)


def hotel_states(g: Graph, metrics: list[str]) -> DataFrame:
    """Per-hotel states over Review-REVIEWED->Hotel paths (no traveller)."""
    return g.hotel_stats.select("hotel_id", *[c for m in metrics for c in (f"{m}_sum", f"{m}_n")])


def merge_by(df: DataFrame, keys: list[str], metrics: list[str], with_paths: bool = False) -> DataFrame:
    aggs = [c for m in metrics for c in merge_sum_count(m)]
    if with_paths:
        aggs = [F.sum("paths").alias("paths")] + aggs
    return df.groupBy(*keys).agg(*aggs)


def with_hotel_name(per_hotel: DataFrame, g: Graph) -> DataFrame:
    return per_hotel.join(g.hotel.select("hotel_id", "name"), "hotel_id")


def with_place(per_hotel: DataFrame, g: Graph) -> DataFrame:
    """Extend each hotel along (Hotel)-->(City)-->(Country): one row per path."""
    return per_hotel.join(g.hotel_place, "hotel_id")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Global top-k: planned as TakeOrderedAndProject (per-partition heaps, one merge)."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, part: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Top-k per group with ``row_number() <= k``; Spark inserts a partial
    WindowGroupLimit before the shuffle, so a hot group ships at most k rows per
    input partition."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
