"""Travel property graph, path analytics and batch retrieval on Spark."""

from .api import Answers, answer_questions, build_graph_from_files

__all__ = ["Answers", "answer_questions", "build_graph_from_files"]
