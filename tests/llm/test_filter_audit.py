"""Filter audit against every order applied step by step."""

import random
import re
from itertools import permutations

import numpy as np

from tripgraph.llm import filter_audit
from tripgraph.llm.queries import op11_filter_interaction_audit

from . import brute

LABELS = "doc_id bigint, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(docs):
    """Failing letters of each (id, source, text) row."""
    out = []
    for i, _, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        f |= {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in docs) else set()
        out.append(f)
    return out


def report(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, x in labels if x == 1 and i is not None}
    failing, rows = fails(docs), []
    for part in {s or "" for _, s, _ in docs}:
        own = [k for k, (_, s, _) in enumerate(docs) if (s or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            alive = list(own)
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if f in failing[k]]
                redundant = [k for k in own if f in failing[k] and k not in alive]
                alive = [k for k in alive if f not in failing[k]]
                removed_by[f] += len(gone)
                steps.append((f, ["".join(order), step, len(alive), len(gone), len(redundant), sum(failing[k] == {f} for k in own),
                                  sum(docs[k][0] in good for k in gone), sum(docs[k][0] in bad for k in gone)]))
        rows += [(part, *s, removed_by[f]) for f, s in steps]
    return sorted(rows)


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect())


def test_against_brute_force(spark):
    rnd = random.Random(5)
    texts = [None, "", " \t\n", "A", "one two", "x # y", "Ünï Ä " * 60]
    texts += [" ".join(rnd.choice(["cat", "Dog", "mouse#", "LOUD", *map(str, range(200))]) for _ in range(rnd.choice([10, 49, 50, 51, 90]))) for _ in range(30)]
    docs = [(rnd.choice([None, *range(60)]), rnd.choice(["a", "b", "", None]), rnd.choice(texts)) for _ in range(150)]
    docs += [(7, "a", "same"), (7, "a", "same"), (7, "b", "same"), (8, "a", "same"), (None, "c", "same")]
    labels = [(rnd.choice([None, *range(60)]), rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1])) for _ in range(60)]
    d = spark.createDataFrame([(*r, 9, 9) for r in docs], "doc_id bigint, source string, text string, part int, mask int").repartition(3)
    assert rows(filter_audit.audit_filters(d, spark.createDataFrame(labels, LABELS))) == report(docs, labels)


def test_walk_is_inclusion_of_cells():
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 9, (3, 32, 3))
    states = filter_audit.subset_survivors(cells, 5)
    for subset in range(32):
        assert (states[subset] == cells[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], brute.DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert rows(filter_audit.audit_filters(docs, labels)) == []
    one = spark.createDataFrame([(1, None, None, None, None)], brute.DOCS)
    assert rows(filter_audit.audit_filters(one, labels)) == report([(1, None, None)], [])


def test_long_text(spark):
    """Percentages of a text of 22 million words stay in range."""
    df = spark.sql("SELECT 1L AS doc_id, 's' AS source, repeat('a ', CAST(id + 22000000 AS INT)) AS text FROM range(1)")
    got = {(r.filter_order, r.step): r for r in filter_audit.audit_filters(df, spark.createDataFrame([], LABELS)).collect()}
    assert got["BACDE", 1].removed == 1 and got["ABCDE", 1].removed == 0


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").select("doc_id", "source", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{brute.SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows(op11_filter_interaction_audit(spark, brute.SMALL)) == report(docs, labels)
