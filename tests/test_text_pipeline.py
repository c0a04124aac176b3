"""Text neighbours of the question pipeline vs brute force at sf0.001."""

from pyspark.sql import functions as F

from test_plans import plan
from tripgraph.operators.vectors import tfidf_rows
from tripgraph.plans import context as cx
from tripgraph.plans.catalog import questions, source
from tripgraph.plans.text import FEATURE_FIELDS, read_vectors

SMOKE = "/root/testdata/sf0.001"


def answers(spark, parts):
    reviews = source(spark, SMOKE, "reviews").repartition(parts)
    idx = cx.build_text_index(spark, reviews, source(spark, SMOKE, "hotels"))
    q = questions(spark, SMOKE)
    return idx, [{(r["question_id"], r["pos"]): r["text"] for r in f(idx, q).collect()} for f in (cx.text_neighbours, cx.feature_neighbours)]


def test_neighbours_do_not_depend_on_the_files_layout(spark):
    assert answers(spark, 1)[1] == answers(spark, 7)[1]


def test_text_neighbours_match_brute_force(spark):
    idx, (got, _) = answers(spark, 2)
    docs = {}
    postings = idx.text_vectors.postings.collect()
    ids = {r["block"]: r["ids"] for r in postings if not r["token"]}
    for r in postings:
        for row, w in zip(r["rows"], r["weights"]):
            docs.setdefault(ids[r["block"]][row], {})[r["token"]] = w
    text_of = {r["id"]: r["text"] for r in idx.text_docs.collect()}
    q = questions(spark, SMOKE)
    vectors = {r["id"]: dict(zip(r["tokens"], r["weights"])) for r in cx._encode_questions(q, idx.text_idf).collect()}
    for qid, vec in vectors.items():
        score = {i: round(sum(w * docs.get(i, {}).get(t, 0.0) for t, w in vec.items()), 6) for i in text_of}
        best = sorted(score, key=lambda i: (-score[i], i))[:3]
        assert [got[qid, p] for p in (1, 2, 3)] == [text_of[i] for i in best]


def test_long_reviews_are_cut_at_words_and_found(spark):
    hotels = spark.createDataFrame([(1, "Alpha")], "hotel_id bigint, hotel_name string")
    long = " ".join(f"word{k}" for k in range(400))
    reviews = spark.createDataFrame([("r1", 1, long), ("r2", 1, "short one"), ("r2", 1, "short one")], "review_id string, hotel_id bigint, review_text string").selectExpr(
        "*", *[f"CAST(9 AS DOUBLE) AS {c}" for _, c in FEATURE_FIELDS])
    idx = cx.build_text_index(spark, reviews, hotels)
    chunks = [r["text"] for r in idx.text_docs.where("review_id = 'r1'").orderBy("chunk_no").collect()]
    assert len(chunks) > 5 and all(len(c) <= 500 and set(c.split()) <= set(("Hotel: Alpha. Review: " + long).split()) for c in chunks)
    q = spark.createDataFrame([(1, "word333"), (2, "short")], "question_id bigint, user_query string")
    got = {(r["question_id"], r["pos"]): r["text"] for r in cx.text_neighbours(idx, q).collect()}
    assert "word333" in got[1, 1] and got[2, 1] == "Hotel: Alpha. Review: short one" and len(got) == 6


def test_reviews_without_ids_are_told_apart_by_their_text(spark):
    hotels = spark.createDataFrame([(1, "Alpha")], "hotel_id bigint, hotel_name string")
    reviews = spark.range(2000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'r' || (id % 7) END AS review_id", "1L AS hotel_id", "'text ' || (id % 900) AS review_text",
        *[f"CAST(9 AS DOUBLE) AS {c}" for _, c in FEATURE_FIELDS])
    docs = cx._chunks(cx.review_docs(reviews, hotels))
    n, ids = docs.selectExpr("count(DISTINCT COALESCE(review_id, ''), chunk_no, text)", "count(DISTINCT id)").first()
    assert n == ids and docs.where("length(id) < 64").count() == 0


def test_stored_models_answer_by_short_name(spark, tmp_path):
    import pytest

    idx, _ = answers(spark, 1)
    store, q = str(tmp_path / "store"), questions(spark, SMOKE).limit(5)
    for model in ("Hash64", "Hash256"):
        cx.write_document_vectors(idx, store, model)
    assert "PartitionFilters: [isnotnull(model" in plan(read_vectors(spark, store, "Hash64 (small)"))
    a, b = (cx.store_neighbours(store, q, m).collect() for m in ("Hash64 (small)", "Hash256"))
    assert len({r["question_id"] for r in a}) == len({r["question_id"] for r in b}) == 5
    assert sorted(map(tuple, a)) != sorted(map(tuple, b))
    with pytest.raises(KeyError):
        cx.store_neighbours(store, q, "MiniLM")


def test_vector_only_mode_has_only_vector_sections(spark):
    import __spark_entry__ as E

    rows = E.queries()["context_full_vector"](spark, SMOKE).collect()
    assert rows and all(r["context"].startswith("Relevant Text Reviews:\n") for r in rows)
    assert all("\n\nRelevant Hotel Feature Profiles:\n" in r["context"] for r in rows)
    assert not any("(from KG)" in r["context"] for r in rows)


def test_a_search_of_texts_builds_no_features(spark):
    hotels = spark.createDataFrame([(1, "Alpha")], "hotel_id bigint, hotel_name string")
    reviews = spark.createDataFrame([("r1", 1, "quiet room"), ("r2", 1, "short one"), ("r2", 1, "short one")], "review_id string, hotel_id bigint, review_text string").selectExpr(
        "*", *[f"CAST(9 AS DOUBLE) AS {c}" for _, c in FEATURE_FIELDS])
    idx = cx.build_text_index(spark, reviews, hotels)
    q = spark.createDataFrame([(1, "quiet"), (2, "short")], "question_id bigint, user_query string")
    got = {(r["question_id"], r["pos"]): r["text"] for r in cx.text_neighbours(idx, q, 2).collect()}
    assert "quiet" in got[1, 1] and "short" in got[2, 1] and "feature_docs" not in vars(idx)
    # Keys are not stored with the texts, and are brought together by one shuffle.
    assert "id" not in spark.read.parquet(*idx.text_docs.inputFiles()).columns
    one = idx.text_docs.groupBy("id").agg(F.any_value("text").alias("text"))
    assert plan(tfidf_rows(one, "id", "text", idx.text_idf, dealt=True)).count("Arguments: hashpartitioning(id") == 1
    assert [r.id for r in idx.text_vectors.first_ids.collect()] == sorted({r.id for r in idx.text_docs.collect()})
