"""Join of two tables of closed ranges of whole numbers on overlap.

A range is filed under bins of a width that is a power of two and not less than
its length, so that it lies in at most two of them; that power is its level.
Ranges of two levels meet in bins of the greater one: each side is filed once
for every level of the other side, and the join is one on equality of (levels,
bin). A pair that shares two bins is kept in the first. A missing end is open
and reaches as far as any end of either table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import written


def _filed(rows: DataFrame, side: str, other_levels: list[int]) -> DataFrame:
    own, other = ("_la", "_lb") if side == "l" else ("_lb", "_la")
    each = rows.withColumn(other, F.explode(F.array(*[F.lit(x) for x in other_levels]))).withColumnRenamed(f"_{side}_level", own)
    width = F.greatest("_la", "_lb")

    def bin_of(c: str) -> Column:
        return F.call_function("shiftright", F.col(c), width)

    return each.withColumn("_bin", F.explode(F.sequence(bin_of(f"_{side}_lo"), bin_of(f"_{side}_hi"))))


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str]) -> DataFrame:
    """All columns of both tables (no name may be in both) for every pair of
    rows whose ranges share a number. Ends are bigint; a null end is open, a
    range that ends before it begins overlaps nothing."""
    shared = set(left.columns) & set(right.columns)
    if shared:
        raise ValueError(f"columns in both tables: {sorted(shared)}")
    tables = {"l": (written(left, "ranges_left"), left_ends), "r": (written(right, "ranges_right"), right_ends)}
    # Four numbers: the least and greatest end that is given on each side.
    ends = [v for t, (lo, hi) in tables.values() for v in t.agg(F.min(F.least(lo, hi)), F.max(F.greatest(lo, hi))).first() if v is not None]
    low, high = (min(ends), max(ends)) if ends else (0, 0)
    sides, levels = {}, {}
    for side, (t, (lo, hi)) in tables.items():
        t = t.withColumns({f"_{side}_lo": F.coalesce(F.col(lo).cast("bigint"), F.lit(low)), f"_{side}_hi": F.coalesce(F.col(hi).cast("bigint"), F.lit(high))})
        t = t.where(F.col(f"_{side}_lo") <= F.col(f"_{side}_hi"))
        sides[side] = t.withColumn(f"_{side}_level", F.length(F.bin(F.col(f"_{side}_hi") - F.col(f"_{side}_lo"))))
        levels[side] = sorted(r[0] for r in sides[side].select(f"_{side}_level").distinct().collect())  # at most 64 numbers
    if not levels["l"] or not levels["r"]:
        return sides["l"].select(left.columns).join(sides["r"].select(right.columns), F.lit(False))
    met = _filed(sides["l"], "l", levels["r"]).join(_filed(sides["r"], "r", levels["l"]), ["_la", "_lb", "_bin"])
    first = F.call_function("shiftright", F.greatest("_l_lo", "_r_lo"), F.greatest("_la", "_lb"))
    overlap = (F.col("_l_lo") <= F.col("_r_hi")) & (F.col("_r_lo") <= F.col("_l_hi")) & (F.col("_bin") == first)
    return met.where(overlap).select(*left.columns, *right.columns)
