"""Quality classifier: random Fourier features of document statistics, ridge
weights from partition-summed normal equations, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics, so the
ridge score is a kernel machine whose cost does not grow with the labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer, written
from .fit import Calibrated, fit, held_out, labelled, matrix
from .words import SPACES, Words, grams

FOURIER = 200
RIDGE = 1e-4
BANDWIDTH = 2.0  # times the square root of the number of statistics
THRESHOLD = 0.7

_CLASSES = np.zeros((256, 9))
for _k, _bytes in enumerate((
    range(97, 123), range(65, 91), range(48, 58), (32, 9), (10, 13), b".,;:'-", b"!?", b"|", range(128, 256),
)):
    _CLASSES[list(_bytes), _k] = 1


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text; all zero for texts without words."""
    w = Words(data, offsets, SPACES)
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    lower = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))
    caps = (upper[w.end] - upper[w.start] > 1) & (lower[w.end] - lower[w.start] == 0)
    length = w.end - w.start
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    odd = ~((last >= 97) & (last <= 122) | (last >= 65) & (last <= 90) | (last >= 48) & (last <= 57) | (last >= 128) | np.isin(last, list(b".,;:?\"')")))
    out = np.zeros((len(offsets) - 1, 23))
    for i in range(len(out)):
        a, z = w.first[i], w.first[i + 1]
        if a == z:
            continue
        text, h, size = data[offsets[i] : offsets[i + 1]], w.hash[a:z], length[a:z]
        n, share = z - a, np.bincount(text, minlength=256) @ _CLASSES / len(text)
        order = np.sort(h)
        runs = np.diff(np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1], [True]))))
        same = h[1:] == h[:-1]
        lines = np.flatnonzero(text == 10)
        three = grams(h, 3)
        out[i] = [*share, 1 - share.sum(), np.log1p(n), size.mean() / 10, size.std() / 10, np.log1p(size.max()) / 5,
                  len(runs) / n, runs.max() / n, same.mean() if n > 1 else 0.0, len(np.unique(three)) / len(three), caps[a:z].mean(),
                  odd[a:z].mean(), np.log1p(len(lines)) / 5, np.log1p(n / (len(lines) + 1)) / 5, (size <= 3).mean()]
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        x = statistics(*text_buffer(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                                         ["doc_id", "x"])


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of every row, written once."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return written(src.mapInArrow(_features, "doc_id bigint, x array<double>"), "quality_features")


class FourierMap:
    """z(x) = sqrt(2 / D) cos(W standardised(x) + b) with a fixed seed."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        rng = np.random.default_rng(7)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(size=(len(mean), FOURIER)) / (BANDWIDTH * np.sqrt(len(mean)))
        self.b = rng.uniform(0, 2 * np.pi, FOURIER)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / FOURIER) * np.cos(np.clip((x - self.mean) / self.std, -8, 8) @ self.w + self.b)


def fit_quality(features: DataFrame, labels: DataFrame, label_col: str = "quality") -> Calibrated | None:
    """Learn from the labelled rows of ``document_features`` that are not held
    out; None if they do not show both labels."""
    rows = written(labelled(features, labels, label_col), "quality_rows")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0))
            if len(x):
                for i, c in enumerate(x.T):
                    yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "n": [float(len(c))], "s": [float(c.sum())], "q": [float(c @ c)]})

    got = rows.select("x").mapInArrow(sums, "i int, n double, s double, q double").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").toArrow()
    if not got.num_rows:
        return None
    n, s, q = (got.column(k).to_numpy() for k in ("n", "s", "q"))
    return fit(rows, FourierMap(s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))), RIDGE)


def score_features(features: DataFrame, model: Calibrated | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every feature row. Without a
    model (no usable labels) every score is 0.5."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(matrix(b.column(1))) if shared.value else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    out = features.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_score(model: Calibrated | None, text_col: str = "text") -> Column:
    """The score of a text column, for filters that keep all columns of a row."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            rows = pa.RecordBatch.from_arrays([t], ["text"])
            parts = [model.score(statistics(*text_buffer(s.column(0)))) for s in slices(iter([rows]), "text")] if model else [np.full(len(t), 0.5)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.col(text_col))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    score estimates the chance of quality label 1 and depends on the text
    alone; predicted is 1 from 0.7 on. Null and empty texts have all-zero
    statistics and are scored as such; texts without words likewise. Null ids
    are scored, never held out and never learnt from. Repeated rows give
    repeated results. With no usable labels (none, or of one kind) every score
    is 0.5. Other columns are not read. An empty table gives no rows.
    """
    x = document_features(docs, id_col, text_col)
    return score_features(x, fit_quality(x, labels))
