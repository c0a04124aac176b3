"""Neighbours by L2 distance: products rule out, differences score."""

import numpy as np
import pytest

from tripgraph.operators import vectors


@pytest.mark.parametrize("shape", ["plain", "copies", "far", "nan", "few", "huge"])
def test_nearest_by_products_are_those_by_differences(shape):
    rng = np.random.default_rng(5)
    d = rng.normal(size=(3 if shape == "few" else 1500, 16))
    if shape == "copies":
        d = d[rng.integers(0, 4, len(d))]
    if shape == "far":
        d = 1e7 + 1e-3 * d
    if shape == "nan":
        d[::7, 3] = np.nan
    if shape == "huge":
        d *= 1e200
    q, codes = np.concatenate([d[:40], rng.normal(size=(20, 16))]), rng.permutation(len(d))
    with np.errstate(over="ignore", invalid="ignore"):
        want = vectors._top(vectors._dense_scores("l2", q, d), codes, 5)
        got = vectors._nearest(q, d, codes, 5)
    order = lambda x: np.lexsort((codes[x[1]], -x[2], x[0]))
    for a, b in zip(got, want):
        assert np.array_equal(a[order(got)], b[order(want)], equal_nan=a.dtype.kind == "f")


def test_products_rule_out_most_differences(monkeypatch):
    scored, whole = [], np.einsum
    monkeypatch.setattr(vectors.np, "einsum", lambda how, x, *y: (scored.append(x.shape[1]) if how == "qnd,qnd->qn" else None, whole(how, x, *y))[1])
    rng = np.random.default_rng(6)
    vectors._nearest(rng.normal(size=(100, 32)), rng.normal(size=(4096, 32)), np.arange(4096), 3)
    assert 300 <= sum(scored) < 100 * 4096 / 50


@pytest.mark.parametrize("shape", ["plain", "copies", "zero", "nan", "few"])
def test_cosines_above_the_floor_are_those_of_all(shape, monkeypatch):
    rng = np.random.default_rng(7)
    d = rng.normal(size=(3 if shape == "few" else 2500, 16))
    if shape == "copies":
        d = d[rng.integers(0, 4, len(d))]
    if shape == "zero":
        d[::3] = 0
    if shape == "nan":
        d[::7, 3] = np.nan
    q, codes = np.concatenate([d[:40], rng.normal(size=(20, 16))]), rng.permutation(len(d))
    want = vectors._top(vectors._dense_scores("cosine", q, d), codes, 5)
    whole, calls = vectors._top, []
    monkeypatch.setattr(vectors, "_top", lambda *a: (calls.append(1), whole(*a))[1])
    got = vectors._best_cosine(q, d, codes, 5)
    order = lambda x: np.lexsort((codes[x[1]], -x[2], x[0]))
    for a, b in zip(got, want):
        assert np.array_equal(a[order(got)], b[order(want)], equal_nan=a.dtype.kind == "f")
    assert shape != "plain" or len(calls) == 1  # the first part only


def test_blocks_grow_with_the_number_of_pairs(spark):
    d = spark.createDataFrame([([0.0] * 64,), (None,)], "vec array<float>")
    assert vectors._block_rows(2000, 2000, d, 4096, 8192) == (4096, 8192)
    assert vectors._block_rows(720_000, 720_000, d, 4096, 8192) == (16384, 16384)
    wide = spark.createDataFrame([([0.0] * 512,)], "vec array<float>")
    assert vectors._block_rows(720_000, 720_000, wide, 4096, 8192) == (4096, 8192)
