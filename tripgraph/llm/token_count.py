"""Token counts by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at
each character of a word; dynamic programming keeps, for each end, the best
score and the number of pieces on the way to it, and no path. Ties follow the
tokenizer: of equal scores the piece that starts first (the longest) wins. Each
distinct marked word of a slice of texts is counted once; a text's count is the
sum over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import MARK, MODEL, Vocabulary, load_model, marked_words


# Larger slices repeat fewer words but take more memory: 3 MB of text some 100 MB in a worker, 8 MB some 300 MB.
SLICE = 3_000_000


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.unknown = vocabulary.unknown_score
        self.by_bytes = len(vocabulary.bytes) == 256
        self.automaton = ahocorasick.Automaton()
        for text, (_, score) in vocabulary.texts().items():
            self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()

    def count(self, word: str) -> int:
        """The number of pieces of one word (with marks)."""
        n = len(word)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        done, unknown = 0, self.unknown  # ends up to ``done`` are final
        matches: list[tuple[int, float]] = []

        def close(end: int) -> None:
            top = steps = None
            single = False
            for length, score in matches:
                start = end - length
                single = single or length == 1
                score += best[start]
                if top is None or score > top:
                    top, steps = score, pieces[start] + 1
            if not single:
                score = best[end - 1] + unknown
                if top is None or score > top:
                    size = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.by_bytes else 1
                    top, steps = score, pieces[end - 1] + size
            best[end], pieces[end] = top, steps

        for at, match in self.automaton.iter(word):
            while done < at:
                done += 1
                close(done)
                matches.clear()
            # Of the matches with one end, the automaton gives the longest first.
            matches.append(match)
        while done < n:
            done += 1
            close(done)
            matches.clear()
        return pieces[n]

    def counts(self, texts: pa.Array) -> np.ndarray:
        words, numbers, first = marked_words(texts)
        of = np.array([self.count(w.replace(" ", MARK)) for w in words.to_pylist()], np.int64)
        total = np.concatenate(([0], np.cumsum(of[numbers]))) if len(numbers) else np.zeros(1, np.int64)
        return total[first[1:]] - total[first[:-1]]


def count_tokens(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs``.

    The counts are those of the model's pieces and scores as a unigram model
    over the marked text. Null and empty texts count 0. Characters without a
    piece count as their UTF-8 bytes where the vocabulary has byte pieces, else
    as one. Repeated rows and null ids are carried. Other columns are not read.
    An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_model(docs.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value.kept(Counter)
        for b in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter.counts(b.column(1)), pa.int64())], ["doc_id", "n_tokens"])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id bigint, n_tokens bigint")
