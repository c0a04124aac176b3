"""The pipeline's stages against brute force, on a small folder of tables."""

import hashlib

import pytest

import corpus_pipeline as cp
from tripgraph.llm import minhash, pieces, quality_rff, secret_forest, sp_trie

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{brute.SF}/documents.parquet")


def test_stages():
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None


def test_quality_follows_the_classifier(spark, docs):
    out = cp.quality(spark, docs, brute.SF)
    assert out.columns == COLUMNS
    labels = spark.read.parquet(f"{brute.SF}/labels.parquet")
    want = {r.doc_id for r in quality_rff.score_documents(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in out.collect()} == want and 0 < len(want) < docs.count()


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    out = cp.near_dedup(spark, docs, brute.SF)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = {i for i, (_, c) in brute.near_duplicates(rows, cp.NEAR).items() if i == c}
    assert out.columns == COLUMNS and sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_near_dedup_links_at_80_per_cent(spark, docs):
    base = [f"w{k}" for k in range(50)]  # 46 shingles; a changed word takes 5
    rows = [(1, " ".join(base)), (2, " ".join([*base[:25], "x", *base[26:]])), (3, " ".join([*base[:15], "x", *base[16:30], "y", *base[31:]]))]
    a, b = (brute.shingles(t) for _, t in rows[:2])
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], brute.DOCS)
    assert sorted(r.doc_id for r in cp.near_dedup(spark, df, brute.SF).collect()) == [1, 3]
    assert cp.near_dedup(spark, docs, brute.SF).count() == 922  # by brute force at 80; 926 at 85


def test_decontaminate(spark, docs):
    out = cp.decontaminate(spark, docs, brute.SF)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(i for i, _, h, _ in brute.contamination(rows, items) if not h)
    assert out.columns == COLUMNS and sorted(r.doc_id for r in out.collect()) == want


def test_secrets(spark, docs):
    out = cp.secrets(spark, docs, brute.SF)
    assert out.columns == COLUMNS
    text = {r.doc_id: r.text for r in docs.collect()}
    spans = {}
    for r in secret_forest.scan(docs).where("secret").collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.start + len(r.value)))
    for r in out.collect():
        t = text[r.doc_id]
        for a, z in sorted(spans.get(r.doc_id, []), reverse=True):
            t = t[:a] + secret_forest.REDACTED + t[z:]
        assert r.text == t


def test_encode(spark, docs):
    codec = sp_trie.Codec(pieces.load_model(spark))
    import pyarrow as pa

    text = {r.doc_id: r.text for r in docs.collect()}
    for r in cp.encode(spark, docs, brute.SF).limit(50).collect():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
        assert r.ids == codec.encode(pa.array([text[r.doc_id]]))[0].tolist() and r.n_pieces == len(r.ids)


def test_odd_rows_through_every_stage(spark):
    """Nulls, empty texts, repeats of an id, and columns that clash with the stages' own names."""
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long), (2, long), (2, long), (2, "other"), (None, long), (None, None), (3, None), (4, ""), (4, ""), (5, 'token = "' + "0a1b2c3d4e" * 4 + '"')]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, 4, 5) for i, t in rows],
                               brute.DOCS + ", row int, own int, found int, stays int")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    kept = [(r.doc_id, r.text) for r in cp.near_dedup(spark, df, brute.SF).collect()]
    # Of id 2, the text that copies id 1 goes, the other one stays.
    assert sorted(kept, key=key) == sorted([(1, long), (2, "other"), (None, long), (None, None), (3, None), (4, ""), (5, rows[-1][1])], key=key)
    for stage in (cp.quality, cp.near_dedup, cp.decontaminate, cp.secrets):
        assert stage(spark, df, brute.SF).columns == df.columns
        assert stage(spark, df.limit(0), brute.SF).collect() == []
    assert len(cp.decontaminate(spark, df, brute.SF).collect()) == len(rows)
    assert len(cp.secrets(spark, df, brute.SF).collect()) == len(rows)
    assert cp.encode(spark, df, brute.SF).count() == len(rows) and cp.encode(spark, df.limit(0), brute.SF).collect() == []


def test_run(spark):
    docs = spark.read.parquet(f"{brute.SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{brute.SMALL}/labels.parquet")
    good = {r.doc_id for r in quality_rff.score_documents(docs, labels).where("predicted = 1").collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if r.doc_id in good]
    one = {i for i, (_, c) in brute.near_duplicates(rows, cp.NEAR).items() if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{brute.SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    clean = sorted(i for i, _, h, _ in brute.contamination([r for r in rows if r[0] in one], items) if not h)
    assert sorted(r.doc_id for r in cp.run(spark, brute.SMALL).collect()) == clean


def test_wide_ids_of_the_broadcast_bound(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    a = sorted(r.doc_id for r in cp.near_dedup(spark, docs, brute.SF).collect())
    monkeypatch.undo()
    assert a == sorted(r.doc_id for r in cp.near_dedup(spark, docs, brute.SF).collect())
