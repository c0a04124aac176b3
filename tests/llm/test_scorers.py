"""Quality and toxicity scores: held-out accuracy, folds, odd rows."""

import zlib

import numpy as np
import pytest

from tripgraph.llm import quality_rff, toxicity_zstd
from tripgraph.llm.fit import isotonic
from tripgraph.llm.queries import op4_compression_toxicity, op6_rff_quality

from . import brute


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("query, label, cut, least", [(op6_rff_quality, "quality", 0.7, 0.97), (op4_compression_toxicity, "toxic", 0.3, 0.85)])
def test_held_out(spark, query, label, cut, least):
    sf = "/root/testdata/sf0.1"
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    out = [(r.score, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    assert auc(np.array([s for s, _ in out]), np.array([v for _, v in out])) > least


@pytest.mark.parametrize("score, none", [(quality_rff.score_documents, 0.5), (toxicity_zstd.score_documents, 0.0)])
def test_odd_rows(spark, score, none):
    rows = [(1, "some words", 0.5, 1), (1, "some words", 0.5, 2), (2, None, 0.5, 1), (None, "", 0.5, 1), (3, "x" * 50_000, 0.5, 1), (4, "\n \t", None, None), (6, "é" * 3, 0.1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, label int")
    labels = spark.createDataFrame([(1, 1, 1), (1, None, None), (None, 0, 0), (77, 0, 0), (6, 1, 1)], "doc_id bigint, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        got = score(docs, given).collect()
        assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 1, 2, 3, 4, 6]
        assert {r.score for r in got} == {none}
        assert all(r.held_out is not None for r in got)
    assert score(docs.limit(0), labels).collect() == []


def test_scores_do_not_depend_on_ids_or_partitions(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    labels = spark.read.parquet(f"{brute.SF}/labels.parquet")
    a = {r.doc_id: r.score for r in quality_rff.score_documents(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality_rff.score_documents(docs.repartition(5), labels.repartition(3)).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_short_words_are_evidence(spark):
    rnd = np.random.default_rng(6)
    words = [f"{a}{b}{c}" for a in "kst" for b in "aeiou" for c in ("mer", "lin", "n", "rdo")]
    texts = [[str(w) for w in rnd.choice(words, 60)] for _ in range(160)]
    for t in texts[:80]:
        t[30] = "scum"
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(160)], "doc_id bigint, toxic int")
    made = toxicity_zstd.train_dictionaries(docs, labels, "toxic")
    assert b" scum " in made.toxic and b" scum" not in made.ordinary
    plain = [" ".join(t[:6]).encode() for t in texts]
    marked = [" ".join(["scum", *t[:5]]).encode() for t in texts]
    assert made.evidence(marked).mean() > 0.2 > 0.05 > made.evidence(plain).mean()


def test_isotonic_rises():
    x, y = isotonic(np.arange(6.0), np.array([1, 1, 2, 1, 1, 1.0]), np.array([0, 1, 0, 1, 0, 1.0]))
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    labels = spark.read.parquet(f"{brute.SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - quality, quality) AS quality")
    a = {r.doc_id: r.score for r in quality_rff.score_documents(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality_rff.score_documents(docs, turned).collect()}
    assert a == pytest.approx(b, abs=1e-9)
