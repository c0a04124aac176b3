"""All fourteen queries are registered, with the columns that they promise."""

import __spark_entry__ as E

PROMISED = {
    2: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], 3: ["page_id", "url", "text", "n_chars"],
    4: ["doc_id", "held_out", "score", "predicted"], 6: ["doc_id", "held_out", "score", "predicted"],
    7: ["doc_id", "n_shingles", "component_id", "kept"], 9: ["vec_id", "n_links", "component_id", "kept"],
    10: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    11: ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    12: ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    13: ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
}


def test_names():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1


def test_columns(spark):
    for n, cols in PROMISED.items():
        name = next(q for q in E.queries() if q.startswith(f"op{n}_"))
        assert E.queries()[name](spark, "/root/testdata/sf0.001").columns[: len(cols)] == cols
