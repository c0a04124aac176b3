"""Plan checks: the work stays JVM-side, anti joins are anti joins, top-k
per group is a WindowGroupLimit, and filters reach the scan."""

from fixtures import small_graph
from tripgraph.plans import analytics as A
from tripgraph.plans import retrieval as R


import contextlib
import io


def plan(df, mode="formatted"):
    """The plan text as ``explain`` prints it."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_q1_uses_anti_join(spark):
    p = plan(A.q1_visa_free_travellers(small_graph(spark)))
    assert "LeftAnti" in p


def test_no_python_in_relational_queries(spark):
    g = small_graph(spark)
    for df in (A.q2_top_business_hotels(g), A.q6_improvement_rule(g), R.hotels_by_type_all(g),
               R.best_hotels_all(g, "Comfort", "country")):
        p = plan(df)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
        assert "CartesianProduct" not in p


def test_top_k_per_group_plans_window_group_limit(spark):
    p = plan(R.hotels_by_city_all(small_graph(spark)))
    assert "WindowGroupLimit" in p
    assert "Partial" in p and "Final" in p


def test_global_top_k_is_take_ordered(spark):
    p = plan(A.q2_top_business_hotels(small_graph(spark)))
    assert "TakeOrderedAndProject" in p


def test_filter_pushed_to_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 7 AS k", "repeat('x', 100) AS pad").write.parquet(path)
    p = plan(spark.read.parquet(path).where("k = 3").select("id"))
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,3)]" in p
    assert "ReadSchema: struct<id:bigint,k:bigint>" in p      # pad is pruned


def test_tfidf_shuffles_documents_once(spark):
    """idf: partial aggregate keyed by token only; weights: one shuffle of the
    documents by id, then term counts, the broadcast idf lookup and the
    per-document collect without another exchange."""
    from tripgraph.operators import vectors as V

    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "doc_id bigint, text string")
    idf = V.fit_idf(docs, "doc_id", "text")
    p_idf = plan(idf, "simple")
    assert p_idf.count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning(token" in p_idf
    p = plan(V.tfidf_rows(docs, "doc_id", "text", idf), "simple")
    shuffles = [ln for ln in p.splitlines() if "Exchange hashpartitioning" in ln]
    # The documents by id (REPARTITION_BY_COL) and the idf aggregate by token.
    assert len(shuffles) == 2, shuffles
    assert any("REPARTITION_BY_COL" in ln and "doc_id" in ln for ln in shuffles)
    assert "BroadcastHashJoin" in p
