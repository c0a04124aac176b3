"""Entry points for a user's own files.

    spark = SparkSession.builder.getOrCreate()
    g = build_graph_from_files(spark, {"hotels": ".../hotels.csv", "users": ".../users.csv",
                                       "reviews": ".../reviews.csv", "visa": ".../visa.csv"})
    out = answer_questions(spark, g, questions_df)          # DataFrames, nothing collected
    out.prompts.write.parquet(...)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .functions.text import written
from .operators.graph import Graph, build_and_write, writing_stage
from .plans import context as cx
from .plans.context import TextIndex, build_text_index
from .plans.questions import understand
from .plans.retrieval import RetrievalIndex, retrieval_index
from .session import scratch_path
from .sources.readers import read_sources


def build_graph_from_files(spark: SparkSession, paths: dict[str, str], fmt: str = "csv", out: str | None = None,
                           order_cols: dict[str, str] | None = None) -> Graph:
    """Check all four inputs (one error names every missing path), scan them
    with explicit schemas, build the graph and write it (to ``out`` or the
    shared checkpoint folder). ``order_cols`` names, per source, the column by
    which the last row of a key wins; several files have no order without it."""
    return build_and_write(spark, read_sources(spark, paths, fmt, order_cols), out)


@dataclass
class Answers:
    understood: DataFrame   # one row per question: entities, age groups, sort intent, country mode
    sections: DataFrame     # (question_id, seq, section)
    context: DataFrame      # (question_id, context)
    prompts: DataFrame      # (question_id, prompt)
    query_log: DataFrame    # (question_id, seq, intent, query_name)
    edges: DataFrame        # (question_id, seq, source, rel, target)


def answer_questions(spark: SparkSession, g: Graph, questions: DataFrame, mode: str = cx.HYBRID,
                     index: RetrievalIndex | None = None, text_index: TextIndex | None = None,
                     reviews: DataFrame | None = None, hotels: DataFrame | None = None) -> Answers:
    """Answer a table of (question_id, user_query) in one batch.

    What several sections read is written first: the understood questions, and
    the retrieval index unless one is passed. Vector modes need a text index:
    pass one, or the review and hotel source tables to build it."""
    u = written(understand(g, questions), "understood")
    idx = index
    if idx is None:
        stage = writing_stage(spark, scratch_path(spark, "retrieval"))
        idx = cx.with_edges(g, retrieval_index(g, stage), stage)
    if mode in cx.VECTOR_MODES and text_index is None:
        if reviews is None or hotels is None:
            raise ValueError("vector modes need text_index, or reviews and hotels to build one")
        text_index = build_text_index(spark, reviews, hotels)
    secs = cx.sections(*cx.lines(g, u, questions, idx, text_index, mode))
    ctx = cx.full_context(questions, secs)
    return Answers(
        understood=u, sections=secs, context=ctx, prompts=cx.prompts(u, ctx, mode),
        query_log=cx.query_log(u, mode), edges=cx.explain_edges(g, u, mode, idx),
    )
