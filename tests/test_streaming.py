import pytest

from fixtures import questions, small_graph, small_sources
from tripgraph.plans import context as cx
from tripgraph.plans.retrieval import retrieval_index
from tripgraph.streaming.questions import answer_batch, start


def test_stream_matches_batch(spark, tmp_path):
    g = small_graph(spark)
    idx = retrieval_index(g)
    q = questions(spark, ["Find hotels in Paris", "clean hotels in spain", "hello"])
    src = str(tmp_path / "in")
    q.write.parquet(src)
    sq = start(spark, g, idx, src, str(tmp_path / "out"), str(tmp_path / "ckpt"), available_now=True)
    sq.awaitTermination(300)
    got = {r["question_id"]: r["prompt"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["question_id"]: r["prompt"] for r in answer_batch(g, idx, q).collect()}
    assert got == want and len(got) == 3
    assert "Top Hotels in Paris (from KG):\nHotel: Alpha (Rating: 8.5)\nHotel: Delta (Rating: 0.0)" in got[0]


def test_stream_has_the_sections_of_its_mode(spark, tmp_path):
    g, q = small_graph(spark), questions(spark, ["clean hotels in spain", "hello"])
    idx = retrieval_index(g)
    index = cx.build_text_index(spark, *small_sources(spark))
    src = str(tmp_path / "in")
    q.write.parquet(src)
    for k, mode in enumerate((cx.BASELINE, cx.HYBRID, cx.VECTOR)):
        out = str(tmp_path / f"out{k}")
        start(spark, g, idx, src, out, str(tmp_path / f"ckpt{k}"), available_now=True, mode=mode, text_index=index).awaitTermination(300)
        got = {r["question_id"]: r["prompt"] for r in spark.read.parquet(out).collect()}
        assert got == {r["question_id"]: r["prompt"] for r in answer_batch(g, idx, q, mode, index).collect()}
        assert all((cx.TEXT_HEADER in p) == (mode in cx.VECTOR_MODES) and mode in p for p in got.values())
        assert any("(from KG)" in p for p in got.values()) == (mode in cx.GRAPH_MODES)
    with pytest.raises(ValueError):
        start(spark, g, idx, src, out, str(tmp_path / "c"), mode=cx.VECTOR)
