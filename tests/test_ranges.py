"""Overlap join against all pairs."""

import random

import pytest

from tripgraph.operators.ranges import overlap_join


def made(n, seed, most):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        lo = rnd.choice([None, *[rnd.randint(-most, most) for _ in range(8)]])
        length = rnd.choice([0, 0, 1, 3, 40, most, -2])
        out.append((k, lo, rnd.choice([None, *([lo + length] if lo is not None else [rnd.randint(-most, most)]) * 8])))
    return out


@pytest.mark.parametrize("most", [5, 300, 10**12])
def test_same_as_all_pairs(spark, most):
    a, b = made(80, 1, most), made(60, 2, most)
    inf = float("inf")
    ends = lambda r: (-inf if r[1] is None else r[1], inf if r[2] is None else r[2])
    want = sorted((x[0], y[0]) for x in a for y in b if max(ends(x)[0], ends(y)[0]) <= min(ends(x)[1], ends(y)[1]) and ends(x)[0] <= ends(x)[1] and ends(y)[0] <= ends(y)[1])
    l_, r_ = spark.createDataFrame(a, "i bigint, lo bigint, hi bigint"), spark.createDataFrame(b, "j bigint, lo2 bigint, hi2 bigint")
    got = overlap_join(l_, r_, ("lo", "hi"), ("lo2", "hi2"))
    assert got.columns == ["i", "lo", "hi", "j", "lo2", "hi2"]
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_open_ends_and_empty_tables(spark):
    l_ = spark.createDataFrame([(1, None, None)], "i int, a bigint, b bigint")
    r_ = spark.createDataFrame([(2, None, None), (3, 5, 5), (4, 6, 5)], "j int, c bigint, d bigint")
    assert sorted(r["j"] for r in overlap_join(l_, r_, ("a", "b"), ("c", "d")).collect()) == [2, 3]
    assert overlap_join(l_.limit(0), r_, ("a", "b"), ("c", "d")).collect() == []
    assert overlap_join(l_, r_.limit(0), ("a", "b"), ("c", "d")).columns == ["i", "a", "b", "j", "c", "d"]
    with pytest.raises(ValueError):
        overlap_join(l_, l_, ("a", "b"), ("a", "b"))


def test_join_is_on_equality(spark):
    l_ = spark.createDataFrame([(1, 1, 9)], "i int, a bigint, b bigint")
    r_ = spark.createDataFrame([(2, 3, 4)], "j int, c bigint, d bigint")
    plan = overlap_join(l_, r_, ("a", "b"), ("c", "d"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
