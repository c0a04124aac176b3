"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest

from tripgraph.llm import embed_graph as G

from . import brute


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 16))
    rows = [b for b in base]
    rows += [base[k % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.25]) for k in range(240)]
    rows += [base[0]] * 30 + [base[1] * 3.0] * 2
    return [(100 + k, [float(x) for x in v]) for k, v in enumerate(rows)]


def expected(rows, least=0.95):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    root = brute.components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    return {i: (int(near[k].sum()), root[i]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("shard, block", [(1_000, 2_500), (60, 25)])
def test_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(G, "SHARD", shard)
    monkeypatch.setattr(G, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in G.near_duplicate_vectors(df).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.95 * len(want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.01, 0.0]),
            (None, [1.0, 0.0]), (1, [1.0, 0.0]), (10, [inf, 1.0]), (11, [1e300, 1e298]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, n_links int")
    got = sorted((tuple(r) for r in G.near_duplicate_vectors(df).collect()), key=repr)
    want = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (11, 3, 1, False), (8, 1, 8, True), (9, 1, 8, False), (None, 0, None, True)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 10, 12)]
    assert got == sorted(want, key=repr)
    assert G.near_duplicate_vectors(df.limit(0)).collect() == []
    assert {tuple(r) for r in G.near_duplicate_vectors(df.where("vec_id = 3")).collect()} == {(3, 0, 3, True)}


def test_graph_search_reaches_a_tight_cluster():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(700, 32)), rng.normal(size=32) * 8 + rng.normal(size=(500, 32)) * 0.3])
    x /= np.linalg.norm(x, axis=1)[:, None]
    edges = G.build(x)
    q = np.arange(600, 900)
    qi, at = G.search(x, edges, x[q], q, 0.95)
    truth = x[q] @ x.T >= 0.95
    assert truth[qi, at].all() and len(qi) >= 0.99 * truth.sum() and len(set(zip(qi.tolist(), at.tolist()))) == len(qi)


def test_audit_sees_lost_links(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    nodes = df.mapInArrow(G._unit, "vec_id bigint, vec binary").selectExpr("vec_id AS node", "vec", "CAST(1 AS BIGINT) AS copies")
    links = spark.createDataFrame([(i, n) for i, (n, _) in expected(rows).items()], "node bigint, links bigint")
    assert G.audit(nodes, links, 0.95) == 1.0
    assert G.audit(nodes, links.selectExpr("node", "CAST(links DIV 2 AS BIGINT) AS links"), 0.95) < 0.6


def test_audit_sees_rare_and_small_groups(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1_500, 16))
    x[1_480:] = x[1_460:1_480] + 0.01 * rng.normal(size=(20, 16))  # 20 pairs among 1,500
    rare = [(k, v.tolist()) for k, v in enumerate(x)]
    x = x.copy()
    x[:500] = x[0] + 0.01 * rng.normal(size=(500, 16))  # and a third of all rows in one group
    hub = [(k, v.tolist()) for k, v in enumerate(x)]
    for rows, kept in ((rare, set()), (hub, set(range(500)))):
        nodes = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").mapInArrow(G._unit, "vec_id bigint, vec binary")
        links = spark.createDataFrame([(i, n if i in kept else 0) for i, (n, _) in expected(rows).items()], "node bigint, links bigint")
        assert G.audit(nodes.selectExpr("vec_id AS node", "vec", "CAST(1 AS BIGINT) AS copies"), links, 0.95) < 0.5


def test_failing_search_ends_in_exact_block_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "EXACT_BLOCK", 70)
    monkeypatch.setattr(G, "_links", lambda nodes, least, overlap: nodes.selectExpr("node", "CAST(0 AS BIGINT) AS links", "CAST(NULL AS BIGINT) AS other"))
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    assert {r.vec_id: (r.n_links, r.component_id) for r in G.near_duplicate_vectors(df).collect()} == expected(rows)
