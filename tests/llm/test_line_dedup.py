"""Line dedup against a plain Python version."""

import hashlib
import random

import pytest

from tripgraph.llm import line_dedup
from tripgraph.llm.queries import op13_line_dedup

from . import brute

SPACE = " \t\n\x0b\x0c\r"


def dedup(docs, min_chars=10, min_docs=2):
    last = float("inf")
    holders = {}
    key = lambda line: brute.lower_ascii(line.strip(SPACE))
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(last if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        who = last if i is None else i
        stay = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or min(holders[key(x)]) == who]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def tables():
    rnd = random.Random(3)
    lines = ["", "short", " padded line here\t", "Padded LINE here", "ÄÖÜ äöü ß é", "äöü äöü ß é", "exactly 10", " nine chr ", "\x0bvertical tab line\x0c", " padded line here", "\r"]
    docs = [(rnd.choice([None, *range(25)]), "\n".join(rnd.choice([*lines, f"unique line number {rnd.random()}"]) for _ in range(rnd.choice([1, 2, 5, 40])))) for _ in range(60)]
    return docs + [(100, None), (101, ""), (102, "\n"), (103, "a\n\nb\n"), (104, "same line twice\nsame line twice"), (105, "x\nsame line twice"), *docs[:4], (docs[0][0], "padded line here")]


@pytest.mark.parametrize("frequent", [line_dedup.FREQUENT, 1])
@pytest.mark.parametrize("min_chars,min_docs", [(10, 2), (1, 3)])
def test_against_brute_force(spark, monkeypatch, frequent, min_chars, min_docs):
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    docs = tables()
    d = spark.createDataFrame([(*r, 1, 1) for r in docs], "doc_id bigint, text string, whole int, at int").repartition(3)
    got = line_dedup.dedup_lines(d, min_chars, min_docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == dedup(docs, min_chars, min_docs)


def test_frequent_hashes_are_bounded(spark):
    """Those that are broadcast are fewer than FREQUENT, whatever the table."""
    docs = spark.createDataFrame([(k, "\n".join(f"shared line {j}" for j in range(k % 30))) for k in range(200)], "doc_id bigint, text string")
    shared = line_dedup.shared_lines(line_dedup.document_lines(docs))
    pairs = shared.agg({"n_docs": "sum"}).first()[0]
    for most in (3, 7, 1000):
        assert shared.where(f"n_docs * {most} > {pairs}").count() < most


def test_long_text_and_empty_table(spark):
    long = "\n".join(f"line number {k % 1000} of a very long text" for k in range(200_000))
    docs = [(1, "line number 5 of a very long text"), (2, long)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == dedup(docs)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in dedup(docs)]
    assert sorted((tuple(r) for r in op13_line_dedup(spark, brute.SMALL).collect()), key=repr) == sorted(want, key=repr)
