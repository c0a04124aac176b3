"""Connected components of an edge table as Spark joins: alternating large-star
and small-star rounds, each written to the shared folder. A node's neighbours
are only ever reduced to their minimum, so a hub with a third of all edges is
pre-aggregated before the shuffle and its join side is split by AQE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionAll(low.select("u", F.col("m").alias("v")))


def _stars(e: DataFrame) -> bool:
    """Whether every upper end of the edges has one edge and is no lower end: a
    round changes nothing then."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(
        e.select("v", F.lit(0), F.lit(1)))
    counted = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return counted.where("down > 1 OR down > 0 AND up > 0").limit(1).count() == 0


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v bigint; loops, nulls
    and repeats are allowed and ignored): component is the smallest node that
    can be reached. An empty edge table gives an empty result.

    The edges are made and written once, before the rounds read them several times."""
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not _stars(e):
        e = written(_small_star(_large_star(e)).where("u <> v").distinct(), name)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component")))
