"""Merkle manifest against a tree built and climbed in plain Python."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tripgraph.llm import merkle
from tripgraph.llm.queries import op12_merkle_manifest

from . import brute

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def climb(tree, pos, digest):
    """(siblings, root) from place ``pos`` of the lowest level, with ``digest`` there."""
    siblings = []
    for nodes in tree[:-1]:
        run = nodes[pos // 8 * 8 : pos // 8 * 8 + 8]
        siblings += run[: pos % 8] + run[pos % 8 + 1 :]
        run[pos % 8] = digest
        digest, pos = sha("".join(run)), pos // 8
    return siblings, digest


def manifest(docs):
    """Rows (doc_id, text, lang, source, n_chars)."""
    langs = sorted({d[2] for d in docs}, key=lambda v: (v is not None, (v or "").encode()))
    trees, groups = [], []
    for lang in langs:
        group = sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, leaf(*d)))
        groups.append(group)
        trees.append(levels([leaf(*d) for d in group]))
    top = levels([t[-1][0] for t in trees])
    rows = []
    for g, (tree, group) in enumerate(zip(trees, groups)):
        for pos, d in enumerate(group):
            changed = d
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 and d[1] is not None:
                changed = (d[0], brute.lower_ascii(d[1]), *d[2:])
            a, sub = climb(tree, pos, leaf(*changed))
            b, folded = climb(top, g, sub)
            rows.append((d[0], tree[0][pos], tree[-1][0], top[-1][0], sha("".join(a + b)), folded, folded == top[-1][0]))
    return sorted(rows, key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect()), key=repr)


def made(n, langs, seed):
    rnd = random.Random(seed)
    texts = [None, "", "plain", "Loud Ä", "x" * 3000]
    docs = [(k if k % 11 else None, rnd.choice(texts), rnd.choice(langs), rnd.choice([None, "s", "é"]), rnd.choice([None, k])) for k in range(-5, n)]
    return docs + docs[:3] + [(docs[0][0], "other", *docs[0][2:])]


@pytest.mark.parametrize("n,langs", [(700, ["en", "de", None, "", "é"]), (60, ["en"]), (30, [f"l{k}" for k in range(20)]), (-4, ["en"])])
def test_against_brute_force(spark, n, langs, monkeypatch):
    # Small chunks, so that rungs of several levels are stored once per chunk.
    monkeypatch.setattr(merkle, "CHUNK_LEVELS", 1)
    monkeypatch.setattr(merkle, "CHUNK", 8)
    docs = made(n, langs, n)
    d = spark.createDataFrame([(*r, 1, 1) for r in docs], f"{brute.DOCS}, tree int, pos int").repartition(3)
    assert rows(merkle.tamper_audit(d)) == manifest(docs)


def test_single_leaf_and_empty_table(spark):
    one = [(6, "One", "en", None, 3)]
    assert rows(merkle.tamper_audit(spark.createDataFrame(one, brute.DOCS))) == manifest(one)
    assert rows(merkle.tamper_audit(spark.createDataFrame([], brute.DOCS))) == []


def test_chunks_bound_the_rows_of_a_join_key(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK_LEVELS", 1)
    monkeypatch.setattr(merkle, "CHUNK", 8)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    _, rungs, trees, root, _ = merkle.build_manifest(docs)
    assert trees.count() == 1 and len(root) == 64
    keys = rungs.groupBy("tree", "chunk", "level", "at").count()
    assert keys.where("count > 1").count() == 0
    per_level = {r.level: r["count"] for r in rungs.groupBy("level").count().collect()}
    assert per_level == {1: 75, 2: 75, 3: 75, 4: 75}  # one per chunk of eight leaves


def test_session_limits_are_put_back(spark):
    key = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(key, "12345")
    try:
        assert len(rows(merkle.tamper_audit(spark.createDataFrame(made(20, ["en"], 1), brute.DOCS)))) == 29
        assert spark.conf.get(key) == "12345"
    finally:
        spark.conf.unset(key)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = rows(op12_merkle_manifest(spark, brute.SMALL))
    assert got == manifest(docs)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
