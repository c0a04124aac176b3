"""Latent encoder against a full singular value decomposition."""

import random

import numpy as np
import pytest

from tripgraph.operators import encoders, latent


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(6)]
    texts = [" ".join(rnd.choice(topics[k % 6]) for _ in range(rnd.choice([3, 10, 25]))) + " the of" for k in range(n)]
    return texts + [None, "", " - "]


def test_directions_are_those_of_a_full_decomposition(spark, monkeypatch):
    monkeypatch.setattr(latent, "BLOCK", 32)
    texts = corpus()
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    m = latent.fit_latent(df, dims=6, features=256, rounds=15)
    x = np.zeros((len(texts), 256))
    row, col, w = latent.tfidf_matrix(texts, m.idf)
    x[row, col] = w
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(m.directions.T @ m.directions, np.eye(6), atol=1e-9)
    assert np.allclose(m.strengths, s[:6] ** 2, rtol=1e-4)
    assert np.linalg.norm(x @ m.directions) ** 2 >= 0.9999 * (s[:6] ** 2).sum()
    df_want = np.count_nonzero(x, axis=0)
    assert np.allclose(m.idf, np.log((len(texts) + 1) / (df_want + 1)) + 1)


def test_registered_encoder_ranks_by_topic(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    latent.register_latent(df, "TestLatent", dims=8, features=1024)
    got = {r["doc_id"]: np.array(r["embedding"]) for r in encoders.embed(df, "text", "TestLatent (small)", ["doc_id"]).collect()}
    assert {len(v) for v in got.values()} == {8} and np.allclose(got[400], 0) and np.allclose(got[402], 0)
    near = [sorted((k for k in range(400) if k != q), key=lambda k: -float(got[q] @ got[k]))[:5] for q in range(30)]
    # Documents of one topic share few words each, but one direction.
    assert np.mean([k % 6 == q % 6 for q, ks in enumerate(near) for k in ks]) > 0.95


def test_empty_corpus(spark):
    m = latent.fit_latent(spark.createDataFrame([], "text string"), dims=3, features=64)
    assert m.strengths.tolist() == [0, 0, 0] and m.encode(["a b", None]).shape == (2, 3)


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    df = spark.createDataFrame([(t,) for t in corpus(60)], "text string").repartition(parts)
    m = latent.fit_latent(df, dims=2, features=128)
    assert np.allclose(m.strengths, latent.fit_latent(df.coalesce(1), dims=2, features=128).strengths, rtol=1e-9)


def test_memory_does_not_grow_with_a_batch(spark):
    """A batch of many long texts is multiplied in slices of bounded size."""
    import tracemalloc

    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(20000)}" for _ in range(1500)) for _ in range(200)] + [None, "", "w1"]
    m = latent.LatentModel(np.ones(1 << 13), np.random.default_rng(1).normal(size=(1 << 13, 64)), np.ones(64))
    whole = np.zeros((len(texts), 1 << 13))
    row, col, w = latent.tfidf_matrix(texts, m.idf)
    whole[row, col] = w
    want = whole @ m.directions
    tracemalloc.start()
    got = m.encode(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-300))
    assert most < 120e6  # 260,000 entries of 64 numbers take 133 MB, several times over


@pytest.mark.parametrize("entries", [1, 7, 64])
def test_slices_hold_whole_rows(monkeypatch, entries):
    monkeypatch.setattr(latent, "ENTRIES", entries)
    row = np.repeat([0, 1, 3, 4, 9], [3, 20, 1, 1, 5])
    cuts = list(latent._slices(row))
    assert [a for a, _ in cuts[1:]] == [z for _, z in cuts[:-1]] and cuts[0][0] == 0 and cuts[-1][1] == len(row)
    assert all(z - a <= entries or len(set(row[a:z])) == 1 for a, z in cuts)
    assert all(row[z - 1] != row[z] for _, z in cuts[:-1])


def test_texts_are_cut_into_tokens_once(spark, monkeypatch):
    """Rounds read written counts, not texts."""
    seen, whole = [], latent._round
    monkeypatch.setattr(latent, "_round", lambda counted, *a: (seen.append(counted), whole(counted, *a))[1])
    latent.fit_latent(spark.createDataFrame([(t,) for t in corpus(30)], "text string").repartition(3), dims=2, features=64, rounds=2)
    assert len(seen) == 3 and all(d.columns == ["features", "counts"] and d.inputFiles() for d in seen)
    assert seen[0].count() == 33 and latent._counts("b a B", 1 << 20)[latent.zlib.crc32(b"b") % (1 << 20)] == 2


def test_full_matrices_multiply_like_sums(monkeypatch):
    rng = np.random.default_rng(2)
    own, at = np.repeat(np.arange(20), 5), np.concatenate([rng.permutation(30)[:5] for _ in range(20)])
    w, v = rng.normal(size=100), rng.normal(size=(30, 4))
    got = []
    for cells in (1 << 22, 0):
        monkeypatch.setattr(latent, "CELLS", cells)
        features, times, back = latent._matrix(own, at, w)
        got.append((features, times(v), back(times(v))))
    assert all(np.allclose(a, b) for a, b in zip(*got))
