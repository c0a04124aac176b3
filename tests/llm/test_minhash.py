"""MinHash near-dedup against brute force, and its sketches."""

import random

import numpy as np

from tripgraph.llm import components, minhash
from tripgraph.llm.components import connected_components
from tripgraph.llm.words import mix

from . import brute


def result(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 900):
        s = minhash.sketch(np.unique(mix(rng.integers(1, 2**63, n).astype(np.uint64))))
        assert s.shape == (minhash.BINS,) and (s > 0).all()
    base = np.unique(mix(np.arange(1, 1201, dtype=np.uint64)))
    a, b = base[:1000], base[200:]  # similarity 800 / 1200
    same = (minhash.sketch(np.sort(a)) == minhash.sketch(np.sort(b))).mean()
    assert abs(same - 2 / 3) < 0.1


def test_sketch_does_not_depend_on_order():
    x = mix(np.arange(1, 50, dtype=np.uint64))
    assert (minhash.sketch(x) == minhash.sketch(x[::-1])).all()


def test_bands_miss_no_pair_at_their_threshold():
    assert [minhash.band_rows(p) for p in (85, 80)] == [8, 6]
    base = mix(np.arange(1, 20_001, dtype=np.uint64))
    for k in range(150):  # 40 of 50 elements shared
        x = base[k * 100 : k * 100 + 50]
        a, b = (minhash.bands(minhash.sketch(s), minhash.band_rows(80)) for s in (x[:45], x[5:]))
        assert (a == b).any()


def corpus():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 40, 120, 300]))]
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            docs.append(" ".join(copy))
    docs += ["", "   \n\t", "one two", "One  TWO", "one two three four five", "ONE two three four five", docs[3], docs[3]]
    rnd.shuffle(docs)
    return list(enumerate(docs, 1)) + [(900, None)]


def test_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    for per_cent in (80, 85):
        want = sorted((i, n, c, i == c) for i, (n, c) in brute.near_duplicates(docs, per_cent).items())
        assert sorted(tuple(r)[:4] for r in minhash.near_duplicates(df, per_cent).collect()) == want


def test_many_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SETS", 3)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = {i: c for i, (_, c) in brute.near_duplicates(docs, 85).items()}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 85).collect()} == want


def test_odd_rows(spark):
    text = " ".join(f"x{k}" for k in range(30))
    rows = [(5, text, 1, "a"), (5, text, 2, "b"), (3, text.upper(), None, None), (None, text, 3, "c"), (None, None, 4, None), (7, None, 5, "d"), (7, "other words", 6, "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles int, set_key string")
    assert result(minhash.near_duplicates(df, 85)) == sorted(
        [(5, 26, 3, False), (5, 26, 3, False), (3, 26, 3, True), (None, 26, None, True), (None, 0, None, True), (7, 0, 7, True), (7, 1, 7, True)], key=repr)
    assert minhash.near_duplicates(df.limit(0), 85).collect() == []


def test_overlaps_in_chunks():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 200, n).astype(np.uint64)) for n in (0, 1, 50, 120, 150, 150)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert minhash.overlaps(sets, chunk=16).tolist() == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(4)
    want = {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 150)}, 200: 200, 201: 200}
    assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).collect() == []


def test_stars_need_no_round_and_edges_are_made_once(spark, monkeypatch):
    rounds, made = [], spark.sparkContext.accumulator(0)
    large_star = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda e: rounds.append(1) or large_star(e))

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    star = spark.createDataFrame([(1, k) for k in range(2, 30)] + [(50, 40)], "u bigint, v bigint").mapInArrow(counted, "u bigint, v bigint")
    assert {r.node: r.component for r in connected_components(star).collect()} == {**dict.fromkeys(range(1, 30), 1), 40: 40, 50: 40}
    assert not rounds and made.value == 29
    path = spark.createDataFrame([(k, k + 1) for k in range(1, 20)], "u bigint, v bigint").mapInArrow(counted, "u bigint, v bigint")
    assert {r.component for r in connected_components(path).collect()} == {1}
    assert rounds and made.value == 29 + 19


def test_groups_of_a_block_are_stars():
    assert sorted(minhash.stars([9, 4, 7, 2, 5, 8], [(0, 1), (1, 2), (3, 4), (4, 3)])) == [(5, 2), (7, 4), (9, 4)]
