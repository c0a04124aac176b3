"""Ridge regression by partition-summed normal equations with cross-fitted
isotonic calibration: what a scorer learns from any number of labelled rows is
summed where the rows are; the driver sees arrays whose size depends on the
number of features alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 3
BINS = 400


def held_out(id_col: str = "doc_id") -> Column:
    """True for ids whose labels must not be learnt from; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled(features: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """Rows of ``features`` (doc_id, x, ...) that may be learnt from, with
    label and fold. Null labels do not count; of repeated ones the largest does."""
    y = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label_col).cast("double").alias("label"))
    fold = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(FOLDS)).cast("int")
    return features.where(~held_out()).join(y, "doc_id").select("doc_id", "x", "label", fold.alias("fold"))


def matrix(col: pa.Array) -> np.ndarray:
    """A list<double> column of equal lengths as rows."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


@dataclass
class Calibrated:
    """weights per fold (the last: all rows) over the map ``phi``, and the
    isotonic knots from raw score to probability."""

    phi: Callable[[np.ndarray], np.ndarray]
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray, fold: int = -1) -> np.ndarray:
        z = self.phi(x)
        return z @ self.weights[fold][:-1] + self.weights[fold][-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0) if len(x) else np.zeros(0)


def _partials(phi):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x, y, fold = matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            if not len(y):
                continue
            z = np.column_stack([phi(x), np.ones(len(y)), y])
            for f in np.unique(fold):
                zf = z[fold == f]
                sums[int(f)] = sums.get(int(f), 0) + zf.T @ zf
        for f, m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())],
                ["fold", "i", "sums"])

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for f, i, row in zip(*(b.column(k).to_pylist() for k in range(3))):
            sums[f, i] = sums.get((f, i), 0) + np.frombuffer(row)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
        ["fold", "i", "sums"])


def _solve(m: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from sums over (features, 1, label); the intercept is not shrunk."""
    d = len(m) - 1
    a, b, n = m[:d, :d], m[:d, d], m[d - 1, d - 1]
    penalty = np.full(d, ridge * max(n, 1.0))
    penalty[-1] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), b)


def isotonic(x: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over ascending ``x``: knots of a rising function."""
    blocks: list[list[float]] = []
    for c, n, s in zip(x, total, ones):
        blocks.append([n, s, c * n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def fit(rows: DataFrame, phi: Callable[[np.ndarray], np.ndarray], ridge: float) -> Calibrated | None:
    """Fit over (x, label, fold); None if the rows do not hold both labels.

    Normal equations are summed per fold, so scores for calibration come from
    weights that never saw their row: each fold's weights use the other folds.
    """
    spark = rows.sparkSession
    parts = rows.select("x", "label", "fold").mapInArrow(_partials(phi), "fold int, i int, sums binary")
    got = parts.repartition("fold", "i").mapInArrow(_total, "fold int, i int, sums binary").toArrow().to_pylist()
    if not got:
        return None
    size = 1 + max(r["i"] for r in got)
    sums = np.zeros((FOLDS, size, size))
    for r in got:
        sums[r["fold"], r["i"]] = np.frombuffer(r["sums"])
    whole = sums.sum(axis=0)
    n, ones = whole[-2, -2], whole[-1, -2]
    if not 0 < ones < n:
        return None
    weights = np.array([_solve(whole - s, ridge) for s in sums] + [_solve(whole, ridge)])
    model = Calibrated(phi, weights, (np.zeros(1), np.zeros(1)))

    shared = spark.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, BINS))
        for b in batches:
            x, y, fold = matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                at = np.clip(((shared.value.raw(x[fold == f], f) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                np.add.at(count[0], at, 1)
                np.add.at(count[1], at, y[fold == f])
        at = np.flatnonzero(count[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[0][at]), pa.array(count[1][at])], ["bin", "n", "ones"])

    table = rows.select("x", "label", "fold").mapInArrow(bins, "bin int, n double, ones double").groupBy("bin").agg(
        F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("bin").toArrow()
    bin_, total, hits = (table.column(k).to_numpy() for k in range(3))
    model.knots = isotonic((bin_ + 0.5) / BINS * 2 - 0.5, total, hits)
    return model
