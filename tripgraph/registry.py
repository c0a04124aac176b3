"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame, and the
matching DuckDB oracle SQL. ``__spark_entry__`` re-exports these."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions.text import py_list_repr
from .operators.graph import check_unique, merge_summary, repeated_keys
from .operators.linking import entity_dictionary, link_entities
from .plans import analytics, questions as qs, retrieval as rt
from .plans import context as cx, text as tx
from .plans.catalog import (driver_table, graph_for, merged_for, questions, retrieval_index_for, source, text_index_for,
                            understood_for)
from .operators import approx, chunking, encoders, latent, ranges, vectors
from .functions.agg import round_dec

Query = Callable[[SparkSession, str], DataFrame]


def _on_graph(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(graph_for(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _on_questions(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(graph_for(spark, sf_dir), questions(spark, sf_dir))

    return run


def _source(name: str) -> Query:
    return lambda spark, sf_dir: source(spark, sf_dir, name)


def _table(name: str, cols: list[str] | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(graph_for(spark, sf_dir), name)
        return df.select(*cols) if cols else df

    return run


def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = understood_for(spark, sf_dir)
    return u.select(
        "question_id", "city", "country", "hotel", "traveller_type", "gender",
        F.when(F.col("age_groups").isNotNull(), py_list_repr("age_groups")).alias("age_groups"),
        "sort_by", "country_mode",
    )


def _on_understood(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(graph_for(spark, sf_dir), understood_for(spark, sf_dir))

    return run


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for name in ("hotels", "users", "reviews", "visa"):
        q[f"src_{name}"] = _source(name)
    for label in ("country", "city", "hotel", "traveller", "review"):
        q[f"nodes_{label}"] = _table(label)
    for edge, table in (("city_country", "city_in_country"), ("hotel_city", "hotel_in_city"),
                        ("from_country", "from_country"), ("wrote", "wrote"), ("reviewed", "reviewed"),
                        ("stayed_at", "stayed_at"), ("needs_visa", "needs_visa")):
        q[f"edge_{edge}"] = _table(table)
    q["hotel_avg_score"] = _table("hotel", ["hotel_id", "average_reviews_score"])
    q["check_unique"] = _on_graph(check_unique)
    # The same job over the source rows, which repeat keys on purpose.
    q["check_unique_sources"] = lambda spark, d: repeated_keys(
        {label: source(spark, d, n) for label, n in (("hotel", "hotels"), ("traveller", "users"), ("review", "reviews"))})
    q["best_hotel_answers"] = _on_graph(lambda g: rt.best_hotel_answers(g, rt.place_requests(g)))
    q["range_overlap"] = _range_overlap
    q["merge_nodes"] = lambda spark, d: merge_summary(
        graph_for(spark, d), {n: source(spark, d, n) for n in ("hotels", "users", "reviews")})

    for table in ("hotel", "review", "stayed_at", "hotel_place"):
        q[f"merge_{table}"] = lambda spark, d, _t=table: getattr(merged_for(spark, d, _t), _t)
    q["merge_segments"] = lambda spark, d: merged_for(spark, d, "segment_stats").segment_stats.select(
        "hotel_id", "age", "type", "gender", "paths", F.col("score_overall_sum").cast("double").alias("score_overall_sum"), "score_overall_n",
        F.col("base3_sum").cast("double").alias("base3_sum"), "base3_n")

    for name in ("q1_visa_free_travellers", "q1_by_home_country", "q2_top_business_hotels", "q3_couples_per_hotel",
                 "q4_least_clean", "q5_best_location_women", "q6_improvement_rule"):
        q[name] = _on_graph(getattr(analytics, name))

    q["entity_dict"] = _on_graph(entity_dictionary)
    q["entity_link"] = _on_questions(lambda g, qq: link_entities(qq, entity_dictionary(g)))
    q["age_range"] = lambda spark, d: qs.age_ranges(questions(spark, d))
    q["age_groups"] = lambda spark, d: qs.question_age_groups(questions(spark, d)).select(
        "question_id", py_list_repr("age_groups").alias("age_groups"))
    q["sort_intent"] = lambda spark, d: qs.sort_intents(questions(spark, d))
    q["route"] = _route

    q["r1_hotels_by_city"] = _on_graph(rt.hotels_by_city_all)
    q["r2_hotels_by_country"] = _on_graph(rt.hotels_by_country_all)
    q["r3_hotels_by_type"] = _on_graph(rt.hotels_by_type_all)
    q["r4_countries_by_type"] = _on_graph(rt.countries_by_type_all)
    q["r5_countries_by_gender"] = _on_graph(rt.countries_by_gender_all)
    q["r6_countries_by_age"] = _on_understood(lambda g, u: rt.countries_by_age_all(g, qs.age_group_requests(u)))
    q["r7_hotels_by_age"] = _on_understood(lambda g, u: rt.hotels_by_age_all(g, qs.age_group_requests(u)))
    for num, dim in zip((8, 9, 10, 11), ("Cleanliness", "Value", "Location", "Comfort")):
        for scope in ("global", "city", "country"):
            q[f"r{num}_{dim.lower()}_{scope}"] = _on_graph(lambda g, _d=dim, _s=scope: rt.best_hotels_all(g, _d, _s))

    # Explanation edges, per parameter value and per question.
    q["z1_city_edges"] = _on_graph(cx.explain_city)
    q["z9_city_fallback_edges"] = _on_graph(cx.explain_city)  # the fallback asks the same pattern
    q["z2_country_edges"] = _on_graph(cx.explain_country)
    q["z3_type_edges"] = _on_graph(cx.explain_type)
    q["z4_gender_edges"] = _on_graph(cx.explain_gender)
    q["z5_age_edges"] = _on_graph(cx.explain_age)
    q["z6_city_top_edges"] = _on_graph(cx.explain_city_top)
    q["z7_country_top_edges"] = _on_graph(cx.explain_country_top)
    q["z8_global_sort_edges"] = _on_graph(cx.explain_global_sort)
    q["z10_country_fallback_edges"] = _on_graph(lambda g: cx.explain_country_top(g, "LOCATED_IN"))
    q["z_explain_edges"] = lambda spark, d: cx.explain_edges(
        graph_for(spark, d), understood_for(spark, d), idx=retrieval_index_for(spark, d))

    # Text and vectors.
    q["review_docs"] = lambda spark, d: tx.review_docs(source(spark, d, "reviews"), source(spark, d, "hotels"))
    q["feature_text"] = lambda spark, d: tx.feature_docs(source(spark, d, "reviews"), source(spark, d, "hotels"))
    q["doc_sample"] = lambda spark, d: tx.doc_sample(
        tx.review_docs(source(spark, d, "reviews"), source(spark, d, "hotels")), 1000)
    q["chunk_fixed"] = lambda spark, d: chunking.chunk_fixed(driver_table(spark, d, "documents"))
    q["chunk_separators"] = lambda spark, d: chunking.chunk_at_separators(driver_table(spark, d, "documents"))
    q["chunk_recursive"] = lambda spark, d: chunking.chunk_recursive(driver_table(spark, d, "documents"))
    q["tfidf_weights"] = _tfidf_weights
    q["knn_l2"] = lambda spark, d: _knn(spark, d, 3, "l2")
    q["knn_cosine"] = lambda spark, d: _knn(spark, d, 10, "cosine")
    q["knn_approx"] = _knn_approx
    q["store_topk"] = _store_topk
    q["latent_store"] = _latent_store
    q["knn_dedup"] = _knn_dedup
    q["vec_scan"] = _vec_scan
    q["text_topk"] = lambda spark, d: cx.text_neighbours(text_index_for(spark, d), questions(spark, d))
    q["feature_topk"] = lambda spark, d: cx.feature_neighbours(text_index_for(spark, d), questions(spark, d))

    # Context and prompts: graph-only mode (oracle-checked) and hybrid mode.
    q["context_sections"] = lambda spark, d: _sections(spark, d, cx.BASELINE)
    q["context_full"] = lambda spark, d: _context(spark, d, cx.BASELINE)
    q["prompts"] = lambda spark, d: _prompts(spark, d, cx.BASELINE)
    q["query_log"] = _on_understood(lambda g, u: cx.query_log(u))
    q["context_full_hybrid"] = lambda spark, d: _context(spark, d, cx.HYBRID)
    q["prompts_hybrid"] = lambda spark, d: _prompts(spark, d, cx.HYBRID)
    q["context_full_vector"] = lambda spark, d: _context(spark, d, cx.VECTOR)
    return q


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _knn(spark: SparkSession, sf_dir: str, k: int, metric: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    out = vectors.knn_dense(e, e, k, metric)
    return out.select("query_id", "pos", "neighbor_id", round_dec("score", 6).alias("score"))


def _store_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours answered from the vector store: the given vectors are written
    under one model beside another's, and read back by the model's name."""
    from .session import scratch_path

    path, e = scratch_path(spark, "topk_vectors"), driver_table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("bigint").alias("hotel_id"), F.lit("").alias("text"), "embedding")
    tx.write_vectors(rows, path, "Given")
    tx.write_vectors(rows.withColumn("embedding", F.reverse("embedding")), path, "Other")
    stored = tx.read_vectors(spark, path, "Given (64)")
    vec = stored.select(F.col("doc_id").alias("id"), F.col("embedding").alias("vec"))
    nn = vectors.knn_dense(vec, vec, 10, "cosine")
    keys = stored.select(F.col("doc_id").alias("neighbor_id"), F.col("hotel_id").alias("key"))
    return vectors.dedup_by_key(nn, keys).select("query_id", "pos", "neighbor_id", "key")


def _latent_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's vector by the encoder fitted on all documents, from the store."""
    from .session import scratch_path

    docs, path = driver_table(spark, sf_dir, "documents"), scratch_path(spark, "latent_vectors")
    latent.register_latent(docs, "Latent64")
    ids = docs.select("doc_id", F.lit(None).cast("bigint").alias("hotel_id"), "text")
    tx.write_vectors(encoders.embed(ids, "text", "Latent64", ["doc_id", "hotel_id"]), path, "Latent64")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return tx.read_vectors(spark, path, "Latent64").select("doc_id", F.size("embedding").alias("dims"), (F.abs(norm - 1) < 1e-5).alias("unit"))


def _range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation and year: how many orders were under way (from their date to
    the last shipment of a line) at some time while that nation's orders of the
    year were placed."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("bigint")
    orders = driver_table(spark, sf_dir, "orders").join(driver_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select("o_orderkey", "c_nationkey", day("o_orderdate").alias("placed"))
    seasons = orders.groupBy("c_nationkey", F.year(F.date_from_unix_date(F.col("placed").cast("int"))).alias("year")).agg(F.min("placed").alias("first"), F.max("placed").alias("last"))
    shipped = driver_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(day("l_shipdate")).alias("shipped"))
    under_way = orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "placed", "shipped")
    met = ranges.overlap_join(under_way, seasons, ("placed", "shipped"), ("first", "last"))
    return met.groupBy("c_nationkey", "year").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_orderkey").alias("order_keys"))


def _knn_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return approx.knn_approx(e, e, 10).select("query_id", "pos", "neighbor_id", round_dec("score", 6).alias("score"))


def _knn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    nn = vectors.knn_dense(e, e, 10, "cosine")
    keys = driver_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("neighbor_id"), F.col("label").alias("key"))
    return vectors.dedup_by_key(nn, keys).select("query_id", "pos", "neighbor_id", "key")


def _tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token, weight) of every document: the per-document sparse rows
    (norm computed in the same aggregate) flattened back to long form."""
    from .functions.text import written

    docs = driver_table(spark, sf_dir, "documents")
    # The idf is written first: the broadcast size check then counts a parquet
    # table instead of running the idf pass twice.
    idf = written(vectors.fit_idf(docs, "doc_id", "text"), "documents_idf")
    rows = vectors.tfidf_rows(docs, "doc_id", "text", idf)
    return rows.select(F.col("id").alias("doc_id"), F.inline(F.arrays_zip("tokens", "weights"))).select(
        "doc_id", F.col("tokens").alias("token"), round_dec("weights", 6).alias("weight"))


def _vec_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .session import scratch_path

    path = scratch_path(spark, "vectors")
    emb = driver_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("bigint").alias("hotel_id"), "embedding")
    tx.write_vectors(emb, path, "E64")
    turned = F.transform("embedding", lambda x: -x)
    tx.write_vectors(emb.where("doc_id % 3 <> 0").withColumn("embedding", turned), path, "Other")
    out = tx.read_vectors(spark, path, "E64 (dense)")
    return out.select("doc_id", "hotel_id", F.size("embedding").alias("dims"))


def _answer_parts(spark: SparkSession, sf_dir: str, mode: str):
    g = graph_for(spark, sf_dir)
    qq = questions(spark, sf_dir)
    u = understood_for(spark, sf_dir)
    text_index = text_index_for(spark, sf_dir) if mode in cx.VECTOR_MODES else None
    return u, qq, cx.sections(*cx.lines(g, u, qq, retrieval_index_for(spark, sf_dir), text_index, mode))


def _sections(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return _answer_parts(spark, sf_dir, mode)[2]


def _context(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    _, qq, secs = _answer_parts(spark, sf_dir, mode)
    return cx.full_context(qq, secs)


def _prompts(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    u, qq, secs = _answer_parts(spark, sf_dir, mode)
    return cx.prompts(u, cx.full_context(qq, secs), mode)


def oracle_sql() -> dict[str, str]:
    return oracles.all_oracles()
