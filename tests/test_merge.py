"""Merging batches into a written graph equals building it from all of them."""

import os
import random

from pyspark.sql import functions as F

from fixtures import hotels, reviews, users, visa
from tripgraph.operators.graph import build_graph
from tripgraph.operators.merge import merge_batch, new_store
from tripgraph.sources.schemas import REVIEWS


def batches(spark, seed, sizes):
    """Random source rows with few keys: repeats within and across batches,
    reviews before their hotel or traveller, null keys and scores."""
    rnd = random.Random(seed)
    out = []
    for n in sizes:
        score = lambda: rnd.choice([None, 1.0, 2.5, 7.3, 9.9])
        key = lambda most: rnd.choice([None, *range(most)])
        h = [(key(8), rnd.choice("ABC"), rnd.choice(["P", "Q", None]), rnd.choice(["X", "Y", None]), 8.0, score(), 7.0) for _ in range(n // 4)]
        u = [(key(12), rnd.choice(["Male", "Female"]), rnd.choice(["X", "Z", None]), rnd.choice(["18-24", None]), rnd.choice(["Solo", "Couple"])) for _ in range(n // 3)]
        r = [(rnd.choice([None, *"abcdefghijklmnop"]), key(14), key(9), *[score() for _ in range(7)]) for _ in range(n)]
        v = [(rnd.choice("XYZ"), rnd.choice("XYZ"), rnd.choice(["Yes", "No", "1"]), rnd.choice(["a", "b"])) for _ in range(n // 5)]
        out.append([hotels(spark, h), users(spark, u), spark.createDataFrame([(a, b, c, "2020-01-01", f"text {rnd.random()}", *s) for a, b, c, *s in r], REVIEWS), visa(spark, v)])
    return [[df.coalesce(1).withColumn("_ord", F.monotonically_increasing_id() + 1000 * i) for df in b] for i, b in enumerate(out)]


def rows(df, columns):
    return sorted(map(repr, df.select(columns).collect()))


def same(got, want):
    for name, table in want.tables().items():
        assert rows(getattr(got, name), table.columns) == rows(table, table.columns), name


def test_merges_equal_one_build(spark):
    parts = batches(spark, 7, [40, 25, 8])
    store = new_store(spark, buckets=4)
    for k, b in enumerate(parts):
        got = merge_batch(store, *b, batch=k)
    every = parts[0]
    for b in parts[1:]:
        every = [x.unionByName(y) for x, y in zip(every, b)]
    same(got, build_graph(*every))


def test_replaced_moved_and_waiting_reviews(spark):
    store = new_store(spark, buckets=4)
    none = [d.limit(0) for d in (hotels(spark, [(1, "A", "P", "X", 8.0, 8.0, 8.0)]), users(spark, [(1, "Male", "X", "18-24", "Solo")]))]
    no_visa = visa(spark, [("X", "Y", "Yes", "a")]).limit(0)
    no_reviews = reviews(spark, [("a", 1, 1, 8.0, 8.0, 8.0, 8.0, 8.0, 8.0)]).limit(0)
    first = [hotels(spark, [(1, "A", "P", "X", 8.0, 8.0, 8.0)]), users(spark, [(1, "Male", "X", "18-24", "Solo")]),
             reviews(spark, [("a", 1, 1, 8.0, 8.0, 8.0, 8.0, 8.0, 8.0), ("w", 1, 2, 4.0, 4.0, 4.0, 4.0, 4.0, 4.0)]), no_visa]
    g = merge_batch(store, *first, batch=1)
    assert g.review.count() == 1 and g.needs_visa.count() == 0

    # Replaced: the old scores leave the segment's sums.
    g = merge_batch(store, *none, reviews(spark, [("a", 1, 1, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0)]), no_visa, batch=2)
    assert [(r.paths, float(r.score_overall_sum)) for r in g.segment_stats.collect()] == [(1, 2.0)]
    assert g.hotel.first().average_reviews_score == 5.0  # over all rows
    # Moved: the traveller's reviews go to the new segment; the old one is gone.
    g = merge_batch(store, none[0], users(spark, [(1, "Male", "X", "55+", "Solo")]), no_reviews, no_visa, batch=3)
    assert [(r.age, r.paths) for r in g.segment_stats.collect()] == [("55+", 1)]
    # Set free: the hotel of a waiting review arrives.
    g = merge_batch(store, hotels(spark, [(2, "B", "P", "X", 8.0, 8.0, 8.0)]), none[1], no_reviews, no_visa, batch=4)
    assert sorted(r.review_id for r in g.review.collect()) == ["a", "w"] and store.table("pending").count() == 0
    assert sorted((r.hotel_id, r.paths) for r in g.segment_stats.collect()) == [(1, 1), (2, 1)]
    before = g.tables().keys(), rows(g.segment_stats, g.segment_stats.columns)
    g = merge_batch(store, *none, no_reviews, no_visa, batch=5)
    assert (g.tables().keys(), rows(g.segment_stats, g.segment_stats.columns)) == before


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    store = new_store(spark, str(tmp_path / "store"), buckets=16)
    many = [hotels(spark, [(k, f"H{k}", "P", "X", 8.0, 8.0, 8.0) for k in range(40)]), users(spark, [(k, "Male", "X", "18-24", "Solo") for k in range(40)]),
            reviews(spark, [(f"r{k}", k, k, 8.0, 8.0, 8.0, 8.0, 8.0, 8.0) for k in range(40)]), visa(spark, [("X", "Y", "Yes", "a")])]
    merge_batch(store, *many, batch=1)
    files = lambda name: {b: sorted(os.listdir(tmp_path / "store" / name / b)) for b in os.listdir(tmp_path / "store" / name) if b.startswith("bucket=")}
    old = {name: files(name) for name in ("review", "hotel", "segment_stats", "traveller")}
    merge_batch(store, many[0].limit(0), many[1].limit(0), reviews(spark, [("r3", 3, 3, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]), many[3].limit(0), batch=2)
    for name, one in (("review", 1), ("hotel", 1), ("segment_stats", 1), ("traveller", 0)):
        new = files(name)
        assert sum(old[name][b] != new[b] for b in old[name]) == one, name


def test_a_store_keeps_only_what_its_tables_need(spark, tmp_path):
    parts = batches(spark, 11, [30, 12])
    want = build_graph(*[x.unionByName(y) for x, y in zip(*parts)])
    live = {"traveller", "hotel", "hotel_raw", "pending"}
    for table, written, with_text in (("stayed_at", live | {"stayed_at"}, False), ("review", live | {"review_rows", "review"}, True),
                                      ("segment_stats", live | {"review_rows", "wrote", "segment_stats"}, False)):
        store = new_store(spark, str(tmp_path / table), buckets=4, tables=(table,))
        for k, b in enumerate(parts):
            got = merge_batch(store, *b, batch=k)
        columns = getattr(want, table).columns
        assert rows(getattr(got, table), columns) == rows(getattr(want, table), columns), table
        assert set(os.listdir(store.path)) == written
        assert ("text" in store.table("pending").columns) == with_text
