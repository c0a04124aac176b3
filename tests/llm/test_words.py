"""Words and their hashes."""

import random
import re

import numpy as np
import pytest

from tripgraph.llm import minhash, winnowing
from tripgraph.llm.words import NON_WORD, SPACES, Words

PATTERN = {"spaces": (SPACES, r"[^\x20\x09-\x0D]+"), "letters": (NON_WORD, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def batch(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def morse(n, bit=0):
    """Words of two letters each, in the order of the Thue-Morse sequence: a
    sum over powers of an odd base (mod 2 ** 64) cannot tell the two apart."""
    return "".join("ab"[(bin(k).count("1") + bit) & 1] for k in range(n))


@pytest.mark.parametrize("kind", PATTERN)
def test_words(kind):
    separators, pattern = PATTERN[kind]
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aAbB \t1é-") for _ in range(rnd.choice([0, 3, 9, 60, 400]))) for _ in range(400)]
    texts += ["x" * k for k in (1, 7, 8, 9, 63, 64, 65, 128, 129)] + ["x" * 64 + "y", "", " "]
    data, offsets = batch(texts)
    w = Words(data, offsets, separators)
    want = [re.findall(pattern, t.lower()) for t in texts]
    assert w.counts().tolist() == [len(x) for x in want]
    flat = [x for y in want for x in y]
    assert [data[a:b].tobytes().decode().lower() for a, b in zip(w.start, w.end)] == flat
    seen = {}
    for x, h, c in zip(flat, w.hash.tolist(), w.check.tolist()):
        assert seen.setdefault(x, (h, c)) == (h, c)
    assert len({h for h, _ in seen.values()}) == len({c for _, c in seen.values()}) == len(seen)


@pytest.mark.parametrize("n", [8, 64, 1024, 2048])
def test_structured_words_do_not_collide(n):
    data, offsets = batch([morse(n), morse(n, 1)])
    w = Words(data, offsets, SPACES)
    assert w.hash[0] != w.hash[1] and w.check[0] != w.check[1]


def test_structured_words_do_not_link_or_hit(spark):
    docs = spark.createDataFrame([(1, morse(1024)), (2, morse(1024, 1)), (3, f"a b {morse(2048)} c d e"), (4, f"a b {morse(2048, 1)} c d e")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 80).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    items = spark.createDataFrame([(1, morse(1024)), (2, f"a b {morse(2048)} c d e")], "item_id bigint, text string")
    for most in (100, 0):
        got = {r.doc_id: (r.n_hit, r["items"]) for r in winnowing.contaminated(docs, items, broadcast_windows=most).collect()}
        assert got == {1: (1, [1]), 2: (0, []), 3: (6, [2]), 4: (0, [])}


def test_windows_that_share_their_first_hash_are_told_apart():
    import pyarrow as pa

    rows = [(1, 10, 77, 5, [9]), (2, 10, 77, 6, [9]), (3, 10, 99, 5, [9])]
    cols = list(zip(*rows))
    index = winnowing._Index(pa.table([pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4], pa.list_(pa.int64()))], names=list("abcde")))
    for proof, want in ((5, [1]), (6, [2]), (7, [])):
        hit, found = np.zeros(10, bool), []
        index._mark(np.array([[77], [proof]], np.uint64), np.array([0]), 10, hit, found)
        assert hit.all() == bool(want) and index.items_of(np.concatenate(found) if found else []) == want
