"""Questions arriving as a stream: each micro-batch runs the batch pipeline
(understand -> sections -> context -> prompts) against the written graph and
retrieval index, and writes its prompts under ``batch_id=<n>``.

Writing each batch to its own folder with ``overwrite`` makes a retried batch
replace its own output, so the sink is idempotent; progress lives in the
query's checkpoint folder (a shared one on a cluster), beside the one table
that each batch writes for its own sections and the next batch replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import written
from ..operators.graph import Graph
from ..plans import context as cx
from ..plans.context import TextIndex
from ..plans.questions import understand
from ..plans.retrieval import RetrievalIndex
from ..sources.schemas import QUESTIONS


def answer_batch(g: Graph, idx: RetrievalIndex, questions: DataFrame, mode: str = cx.BASELINE,
                 text_index: TextIndex | None = None, scratch: str | None = None) -> DataFrame:
    """(question_id, prompt) for one batch of questions, with the sections that
    ``mode`` names; vector modes need a text index. The understood questions
    are written once (to ``scratch``, replacing what is there, if given)."""
    u = understand(g, questions)
    if scratch is None:
        u = written(u, "understood")
    else:
        u.write.mode("overwrite").parquet(scratch)
        u = questions.sparkSession.read.schema(u.schema).parquet(scratch)
    ctx = cx.full_context(questions, cx.sections(*cx.lines(g, u, questions, idx, text_index, mode)))
    return cx.prompts(u, ctx, mode)


def start(spark: SparkSession, g: Graph, idx: RetrievalIndex, source_dir: str, sink_dir: str, checkpoint: str,
          available_now: bool = False, mode: str = cx.BASELINE, text_index: TextIndex | None = None) -> StreamingQuery:
    """Stream parquet files of (question_id, user_query) from ``source_dir``.
    A mode that needs a text index and has none is refused at once."""
    if mode in cx.VECTOR_MODES and text_index is None:
        raise ValueError(f"mode {mode} needs a text index")
    stream = spark.readStream.schema(QUESTIONS).parquet(source_dir)

    def handle(batch: DataFrame, batch_id: int) -> None:
        out = answer_batch(g, idx, batch, mode, text_index, f"{checkpoint}/understood").withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{checkpoint}/progress")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
