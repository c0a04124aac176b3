import numpy as np

from tripgraph.operators.vectors import dedup_by_key, fit_idf, knn_dense, knn_sparse, sparse_rows, tfidf


def brute(q, d, k, metric):
    if metric == "l2":
        s = -np.sqrt(((q[:, None, :] - d[None, :, :]) ** 2).sum(-1))
    else:
        qn = q / np.linalg.norm(q, axis=1, keepdims=True)
        dn = d / np.linalg.norm(d, axis=1, keepdims=True)
        s = qn @ dn.T
    out = {}
    for i in range(len(q)):
        order = sorted(range(len(d)), key=lambda j: (-s[i, j], j))[:k]
        out[i] = order
    return out


def test_knn_dense_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    d = rng.normal(size=(300, 8))
    q = rng.normal(size=(37, 8))
    corpus = spark.createDataFrame([(i, d[i].tolist()) for i in range(len(d))], "id bigint, vec array<double>").repartition(5)
    queries = spark.createDataFrame([(i, q[i].tolist()) for i in range(len(q))], "id bigint, vec array<double>")
    for metric in ("l2", "cosine"):
        want = brute(q, d, 4, metric)
        # small blocks force several block pairs
        got = knn_dense(queries, corpus, 4, metric, query_rows=10, corpus_rows=64).collect()
        res = {}
        for r in got:
            res.setdefault(r["query_id"], []).append((r["pos"], r["neighbor_id"]))
        assert {k: [n for _, n in sorted(v)] for k, v in res.items()} == want


def test_knn_ties_break_on_smaller_id(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9, 1)], "id bigint, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "id bigint, vec array<double>")
    got = [r["neighbor_id"] for r in knn_dense(queries, corpus, 3, "cosine").orderBy("pos").collect()]
    assert got == [1, 3, 5]


def test_knn_k_equals_n_is_full_sort(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(size=(20, 3))
    corpus = spark.createDataFrame([(i, d[i].tolist()) for i in range(20)], "id bigint, vec array<double>")
    got = [r["neighbor_id"] for r in knn_dense(corpus.limit(1), corpus, 20, "l2").orderBy("pos").collect()]
    assert got == brute(d[:1], d, 20, "l2")[0]


def test_sparse_knn_matches_dense_tfidf(spark):
    docs = spark.createDataFrame(
        [(1, "red apple pie"), (2, "green apple"), (3, "blue sky"), (4, "red red sky"), (5, "nothing")],
        "id bigint, text string")
    qs = spark.createDataFrame([(10, "red apple"), (11, "sky"), (12, "unknownword")], "id bigint, text string")
    idf = fit_idf(docs, "id", "text")
    drows = sparse_rows(tfidf(docs, "id", "text", idf))
    qrows = sparse_rows(tfidf(qs, "id", "text", idf))
    vocab = sorted({r["token"] for r in idf.collect()})
    def dense(rows):
        out = {}
        for r in rows.collect():
            v = np.zeros(len(vocab))
            for t, w in zip(r["tokens"], r["weights"]):
                v[vocab.index(t)] = w
            out[r["id"]] = v
        return out
    dd, qq = dense(drows), dense(qrows)
    got = {}
    for r in knn_sparse(qrows, drows, 2).collect():
        got.setdefault(r["query_id"], []).append((r["pos"], r["neighbor_id"]))
    for qid, qv in qq.items():
        want = sorted(dd, key=lambda j: (-float(qv @ dd[j]), j))[:2]
        assert [n for _, n in sorted(got[qid])] == want


def test_dedup_keeps_best_per_key_and_keyless(spark):
    knn = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.8), (1, 3, 12, 0.7), (1, 4, 13, 0.6)],
                                "query_id bigint, pos int, neighbor_id bigint, score double")
    keys = spark.createDataFrame([(10, "h1"), (11, "h1"), (12, None), (13, "h2")], "neighbor_id bigint, key string")
    got = [(r["pos"], r["neighbor_id"]) for r in dedup_by_key(knn, keys).orderBy("pos").collect()]
    assert got == [(1, 10), (2, 12), (3, 13)]


def test_fused_tfidf_rows_equal_two_step(spark):
    from tripgraph.operators.vectors import tfidf_rows
    docs = spark.createDataFrame([(1, "a b b c"), (2, "b c"), (3, "c c c d"), (4, None)], "id bigint, text string")
    idf = fit_idf(docs, "id", "text")
    a = {r["id"]: dict(zip(r["tokens"], r["weights"])) for r in sparse_rows(tfidf(docs, "id", "text", idf)).collect()}
    b = {r["id"]: dict(zip(r["tokens"], r["weights"])) for r in tfidf_rows(docs, "id", "text", idf).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].keys() == b[k].keys()
        for t in a[k]:
            assert abs(a[k][t] - b[k][t]) < 1e-12


def test_tfidf_values_by_hand_and_unbroadcast_path(spark):
    """Hand-computed weights; the shuffle-join path (idf beyond the broadcast
    bound) gives the same rows as the broadcast path."""
    import math

    from tripgraph.operators.vectors import tfidf_rows
    docs = spark.createDataFrame([(1, "A a b"), (2, "b, c!"), (3, None)], "id bigint, text string")
    idf = {r["token"]: (r["df"], r["idf"]) for r in fit_idf(docs, "id", "text").collect()}
    # Three documents (the NULL text counts), document frequencies a:1 b:2 c:1.
    assert {t: d for t, (d, _) in idf.items()} == {"a": 1, "b": 2, "c": 1}
    assert abs(idf["b"][1] - (math.log(4 / 3) + 1)) < 1e-12
    i_a, i_b = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    norm = math.hypot(2 * i_a, i_b)
    idf_df = fit_idf(docs, "id", "text")
    fast = {r["id"]: dict(zip(r["tokens"], r["weights"])) for r in tfidf_rows(docs, "id", "text", idf_df).collect()}
    slow = {r["id"]: dict(zip(r["tokens"], r["weights"]))
            for r in tfidf_rows(docs, "id", "text", idf_df, idf_max_rows=0).collect()}
    assert fast.keys() == slow.keys() == {1, 2}
    assert abs(fast[1]["a"] - 2 * i_a / norm) < 1e-12 and abs(fast[1]["b"] - i_b / norm) < 1e-12
    for k in fast:
        assert fast[k].keys() == slow[k].keys()
        for t in fast[k]:
            assert abs(fast[k][t] - slow[k][t]) < 1e-12


def test_repeats_of_a_query_id_are_answered_each(spark):
    """More rows of one id than a block should hold: no block grows with them, none is refused."""
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id bigint, vec array<double>")
    queries = spark.createDataFrame([(1, [float(i % 3), 1.0]) for i in range(40)], "id bigint, vec array<double>")
    got = knn_dense(queries, corpus, 2, "l2", query_rows=4, corpus_rows=4).collect()
    assert len(got) == 80 and {r["query_id"] for r in got} == {1}
    assert sorted(r["neighbor_id"] for r in got if r["pos"] == 1) == sorted(i % 3 for i in range(40))


def test_empty_sides(spark):
    rows = spark.createDataFrame([(1, [1.0])], "id bigint, vec array<double>")
    assert knn_dense(rows.limit(0), rows, 2).collect() == [] and knn_dense(rows, rows.limit(0), 2).collect() == []


def test_encoders_by_name(spark):
    import pytest

    from tripgraph.operators.encoders import embed, models, register

    df = spark.createDataFrame([(1, "red apple"), (2, None), (3, "Red, APPLE!")], "id bigint, text string").repartition(2)
    rows = {r["id"]: r for r in embed(df, "text", "Hash64 (small)", ["id"]).collect()}
    assert len(rows[1]["embedding"]) == 64 and rows[1]["embedding"] == rows[3]["embedding"] and not any(rows[2]["embedding"])
    register("Lengths", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert "Lengths" in models()
    assert [r["embedding"] for r in embed(df, "text", "Lengths", ["id"]).orderBy("id").collect()] == [[9, 1], [0, 1], [11, 1]]
    with pytest.raises(KeyError):
        embed(df, "text", "MiniLM", ["id"])
