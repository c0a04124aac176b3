"""Inverted index against the exact search over all block pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tripgraph.operators import inverted
from tripgraph.operators.inverted import build_index, index_texts, knn_inverted
from tripgraph.operators.vectors import fit_idf, knn_sparse, tfidf_rows

ROWS = "id string, tokens array<string>, weights array<double>"


def made(n, seed, words, prefix="d"):
    """Unit vectors with one token that nearly all have, and ties."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        own = {"the": 0.05 + 0.01 * (k % 3)} if k % 10 else {}
        own |= {rnd.choice(words): rnd.choice([0.5, 0.7, 1.0]) for _ in range(rnd.choice([0, 1, 2, 4]))}
        norm = sum(w * w for w in own.values()) ** 0.5
        out.append((f"{prefix}{k:04d}", list(own), [w / norm for w in own.values()]))
    return out


def answers(df):
    return sorted((r.query_id, r.pos, r.neighbor_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block_docs,slice_queries,k", [(8, 3, 5), (64, 2048, 3), (1024, 1, 20)])
def test_same_as_exact_search(spark, block_docs, slice_queries, k):
    words = [f"w{j}" for j in range(40)]
    corpus = spark.createDataFrame(made(300, 1, words), ROWS).repartition(4)
    asked = made(40, 2, [*words, "unknown"], "q") + [("none", [], []), ("null", None, None), ("far", ["unheard"], [1.0])]
    asked += [asked[3], ("the", ["the"], [1.0])]
    queries = spark.createDataFrame(asked, ROWS).repartition(3)
    clean = queries.select("id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.coalesce("weights", F.array().cast("array<double>")).alias("weights"))
    index = build_index(corpus, fill=20, block_docs=block_docs)
    assert answers(knn_inverted(queries, index, k, slice_queries=slice_queries)) == answers(knn_sparse(clean, corpus, k))


def test_blocks_are_skipped(spark):
    """Documents of one topic share blocks; a query needs those of its topic."""
    corpus = [(f"d{k:05d}", ["the", f"topic{k % 50}", f"own{k}"], [0.1, 0.9, 0.4]) for k in range(2000)]
    queries = [(f"q{k}", ["the", f"topic{k % 50}"], [0.1, 0.99]) for k in range(100)]
    c, q = spark.createDataFrame(corpus, ROWS).repartition(4), spark.createDataFrame(queries, ROWS)
    index = build_index(c, block_docs=32)
    stats = {}
    got = answers(knn_inverted(q, index, 5, stats=stats))
    assert got == answers(knn_sparse(q, c, 5))
    assert stats["skipped"] > 0.9 * stats["all"] and stats["scored"] + stats["skipped"] == stats["all"]


def test_postings_are_bounded(spark):
    index = build_index(spark.createDataFrame(made(300, 1, ["a", "b"]), ROWS).repartition(4), block_docs=16)
    assert index.postings.agg(F.max(F.size("rows"))).first()[0] <= 16
    assert index.postings.where("token = ''").select(F.explode("ids")).distinct().count() == 300
    the = index.postings.where("token = 'the'")
    assert the.count() >= 270 / 16 and the.where("top <> array_max(weights)").count() == 0


def test_empty_tables(spark):
    some, none = spark.createDataFrame(made(5, 1, ["a"]), ROWS), spark.createDataFrame([], ROWS)
    assert knn_inverted(none, build_index(some), 3).collect() == []
    assert knn_inverted(some, build_index(none), 3).collect() == []
    assert len(knn_inverted(some, build_index(some), 10).collect()) == 25
    with pytest.raises(ValueError):
        knn_inverted(some, build_index(some, fill=2), 3)


def test_corpus_is_not_shuffled_per_query_block(spark):
    """One exchange of the postings to (block, part); none of the queries times blocks."""
    index = build_index(spark.createDataFrame(made(50, 1, ["a", "b"]), ROWS), block_docs=8)
    q = inverted.written(spark.createDataFrame([(0, ["a"], [1.0])], "query_row bigint, q_tokens array<string>, q_weights array<double>"), "t")
    pairs = inverted.written(spark.createDataFrame([(0, 0)], "query_row bigint, block bigint"), "p")
    plan = inverted._scored(pairs, q, index, 3, 10)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_texts_are_indexed_where_they_are_read(spark, monkeypatch):
    """No exchange on the way to the postings; rows that repeat an id, in one
    partition or several, are one document; texts without a token are none."""
    rnd, words = random.Random(4), [f"w{j}" for j in range(30)]
    texts = [(f"d{k:03d}", " ".join(["the", *rnd.choices(words, k=rnd.choice([1, 3, 6]))])) for k in range(200)] + [("e", " . "), ("n", None)]
    docs = spark.createDataFrame(texts + texts[::3] + texts[::3], "id string, text string").repartition(5)
    idf = fit_idf(docs, "id", "text")
    queries = spark.createDataFrame(made(40, 2, [*words, "unknown"], "q"), ROWS)
    plans, write = {}, inverted.written
    monkeypatch.setattr(inverted, "written", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().toString()), write(df, name))[1])
    index = index_texts(inverted.written(docs, "docs"), inverted.written(idf, "idf"), fill=20, block_docs=8)
    assert "Exchange" not in plans["index_postings"] and "index_rows" not in plans
    want = answers(knn_sparse(queries, tfidf_rows(docs.dropDuplicates(), "id", "text", idf), 5))
    assert answers(knn_inverted(queries, index, 5)) == want
    assert answers(knn_inverted(queries, index_texts(docs, idf, fill=20, block_docs=8, vocabulary_rows=3), 5)) == want
    ids = index.postings.where("token = ''").select(F.explode("ids").alias("id"))
    assert ids.distinct().count() == 200 and index.first_ids.count() == 40
    assert index_texts(docs.limit(0), idf).postings.count() == 0
