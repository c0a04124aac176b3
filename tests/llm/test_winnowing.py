"""Benchmark decontamination against brute force, by broadcast and by shuffles."""

import random

import pytest

from tripgraph.llm import winnowing
from tripgraph.llm.queries import op10_benchmark_decontamination

from . import brute


def tables():
    rnd = random.Random(9)
    vocabulary = ["a", "b", "c", "é1", "zz"]  # few words: many ties among fingerprints

    def text(n):
        return rnd.choice([" ", ", ", "-"]).join(rnd.choice(vocabulary) for _ in range(n))

    items = [(k, text(rnd.choice([1, 3, 9, 10, 11, 14, 30]) if k % 4 else 25)) for k in range(20)]
    items = [(k, t) for k, t in items if len(t) > 12] + [(50, ""), (51, None), (52, "!?"), (53, items[4][1]), (53, items[4][1])]
    docs = [(k, text(rnd.choice([2, 9, 10, 40, 200]))) for k in range(40)]
    docs += [(100, "start " + items[4][1].upper() + " end"), (101, items[0][1][3:]), (102, None), (103, ""), (104, "-- --"), (100, "again"), (None, items[4][1])]
    docs += [(105, " ".join(f"word{k}" for k in range(500)))]
    return docs, items


@pytest.mark.parametrize("most", [winnowing.BROADCAST_WINDOWS, 0])
def test_against_brute_force(spark, most):
    docs, items = tables()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, n_hit int").repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = winnowing.contaminated(d, i, broadcast_windows=most)
    key = lambda r: repr(r)
    assert sorted(((r[0], r[1], r[2], tuple(sorted(r[3]))) for r in got.collect()), key=key) == sorted(brute.contamination(docs, items), key=key)
    clean = sorted(((r.doc_id, r.text, r.n_hit) for r in winnowing.keep_clean(d, i, broadcast_windows=most).collect()), key=key)
    hit = brute.contamination(docs, items)
    assert clean == sorted(((*r, 1) for r, h in zip(docs, hit) if not h[2]), key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    for most in (10, 0):
        assert [tuple(r) for r in winnowing.contaminated(docs, items, broadcast_windows=most).collect()] == [(1, 3, 0, [])]
        assert winnowing.contaminated(docs.limit(0), items, broadcast_windows=most).collect() == []


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{brute.SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = {(i, n, h, len(found), brute.items_sha256(found), h > 0) for i, n, h, found in brute.contamination(docs, items)}
    assert {tuple(r) for r in op10_benchmark_decontamination(spark, brute.SMALL).collect()} == want


def test_every_long_shared_span_shares_a_fingerprint():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.integers(0, 3, 40).astype(np.uint64) for _ in range(2))
        b[7:17] = a[21:31]
        ga, gb = (winnowing.grams(x, winnowing.K) for x in (a, b))
        fa = {int(p) - 21 for p in winnowing.fingerprints(a) if 21 <= p <= 26}
        fb = {int(p) - 7 for p in winnowing.fingerprints(b) if 7 <= p <= 12}
        assert fa & fb and (ga[21:27] == gb[7:13]).all()
