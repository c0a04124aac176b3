"""A dense encoder fitted on a corpus: latent directions of TF-IDF rows.

Tokens are hashed to a fixed number of features. The directions that hold most
of the rows' weight (the leading right singular vectors) are found by subspace
iteration over the documents' counts, which are written once: every round, each
partition adds up X'(XV) over its documents, block
by block of features, the blocks are summed over the partitions by a shuffle,
and the driver makes the sum's columns orthonormal. What the driver and each
task hold is features x dimensions numbers and those of a slice of bounded
size, whatever the corpus and the texts of a batch.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import written
from . import encoders

FEATURES, DIMS, ROUNDS, SEED = 1 << 15, 64, 6, 42
# Features of one block of a sum: a row of the shuffle.
BLOCK = 512
# Entries of TF-IDF rows that are multiplied at once (times the dimensions, 8 bytes each), and
# the most cells (rows x features) of a slice that is multiplied as a full matrix.
ENTRIES, CELLS = 1 << 15, 1 << 22
_TOKEN = re.compile(r"[^\W_]+")


def _counts(text: str | None, features: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for t, n in Counter(_TOKEN.findall((text or "").lower())).items():
        f = zlib.crc32(t.encode()) % features
        out[f] = out.get(f, 0) + n
    return out


def tfidf_matrix(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) of each entry; rows have length 1, or no entries."""
    rows, cols, values = [], [], []
    for i, t in enumerate(texts):
        c = _counts(t, len(idf))
        if c:
            at = np.fromiter(c.keys(), np.int64, len(c))
            w = np.fromiter(c.values(), np.float64, len(c)) * idf[at]
            rows.append(np.full(len(at), i))
            cols.append(at)
            values.append(w / np.linalg.norm(w))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def _summed(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``values`` by ``index``."""
    out = np.zeros((n, values.shape[1]))
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
        out[index[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _matrix(own: np.ndarray, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, Callable, Callable]:
    """(features, X -> XV, Y -> X'Y over those features) of a slice's entries; V has
    a row per feature there is. A full matrix where it is small, else sums of rows."""
    n = int(own[-1]) + 1
    features, place = np.unique(at, return_inverse=True)
    if n * len(features) <= CELLS:
        x = np.zeros((n, len(features)))
        x[own, place] = w
        return features, lambda v: x @ v[features], lambda y: x.T @ y
    return features, lambda v: _summed(own, v[at] * w[:, None], n), lambda y: _summed(place, y[own] * w[:, None], len(features))


def _slices(row: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries that hold whole rows: at most ``ENTRIES``, or one row."""
    a = 0
    while a < len(row):
        z = len(row)
        if z - a > ENTRIES:
            z = int(np.searchsorted(row, row[a + ENTRIES]))
            if z <= a:  # one row alone has more
                z = int(np.searchsorted(row, row[a], side="right"))
        yield a, z
        a = z


def _parts(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch in lists of bounded length: 256 texts, and about a
    million bytes beyond one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        most = (sizes[a - 1] if a else 0) + (1 << 20)
        z = max(a + 1, min(a + 256, int(np.searchsorted(sizes, most, side="right"))))
        yield texts.slice(a, z - a).to_pylist()
        a = z


@dataclass
class LatentModel:
    idf: np.ndarray         # features
    directions: np.ndarray  # features x dims, orthonormal columns, strongest first
    strengths: np.ndarray   # dims: squared singular values

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """Rows of length 1; zeros for a text without tokens."""
        y = np.zeros((len(texts), self.directions.shape[1]))
        for first in range(0, len(texts), 256):
            some = texts[first : first + 256]
            row, col, w = tfidf_matrix(some, self.idf)
            for a, z in _slices(row):
                low, high = row[a], row[z - 1] + 1
                y[first + low : first + high] = _matrix(row[a:z] - low, col[a:z], w[a:z])[1](self.directions)
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)


def _counted(docs: DataFrame, text_col: str, features: int) -> DataFrame:
    """(features, counts) of each document, written: texts are cut into tokens once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in _parts(b.column(0)):
                some = [_counts(t, features) for t in texts]
                cut = np.cumsum([0, *map(len, some)]).astype(np.int32)
                flat = [np.fromiter((x for c in some for x in part(c)), np.int32, int(cut[-1])) for part in (dict.keys, dict.values)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cut, pa.array(x)) for x in flat], ["features", "counts"])

    return written(docs.select(text_col).mapInArrow(run, "features array<int>, counts array<int>"), "latent_counts")


def _entries(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, feature, count) of the documents of a batch, in slices of whole rows."""
    lists, counts = b.column(0), b.column(1).flatten().to_numpy()
    row, at = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
    for a, z in _slices(row):
        yield row[a:z] - row[a], at[a:z], counts[a:z]


def _document_frequency(counted: DataFrame, features: int) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(features, np.int64), 0
        for b in batches:
            n += b.num_rows
            df += np.bincount(b.column(0).flatten().to_numpy(), minlength=features)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], n))], ["feature", "n"])

    sums = counted.select("features").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # features + 1 rows
    df, n = np.zeros(features), 0
    for f, k in sums:
        if f < 0:
            n = k
        else:
            df[f] = k
    return df, n


def _round(counted: DataFrame, idf: np.ndarray, v: np.ndarray) -> np.ndarray:
    """X'(XV) over all documents."""
    spark = counted.sparkSession
    shared, shape = spark.sparkContext.broadcast((idf, v)), v.shape

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, v = shared.value
        z = np.zeros(shape)
        for b in batches:
            for own, at, counts in _entries(b):
                w = counts * idf[at]
                w /= np.sqrt(np.bincount(own, w * w))[own]
                features, times, back = _matrix(own, at, w)
                z[features] += back(times(v))
        blocks = [k for k in range(0, shape[0], BLOCK) if z[k : k + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([z[k : k + BLOCK].tobytes() for k in blocks], pa.binary())], ["block", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            for k, s in zip(b.column(0).to_pylist(), b.column(1)):
                part = np.frombuffer(s.as_py(), np.float64)
                if k != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([held.tobytes()], pa.binary())], ["block", "sums"])
                    at, held = k, part.copy()
                else:
                    held += part
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([held.tobytes()], pa.binary())], ["block", "sums"])

    kind = "block bigint, sums binary"
    sums = counted.mapInArrow(products, kind).repartition("block").sortWithinPartitions("block").mapInArrow(total, kind)
    z = np.zeros(shape)
    for k, s in sums.collect():  # features x dims numbers in all
        part = np.frombuffer(s, np.float64).reshape(-1, shape[1])
        z[k : k + len(part)] = part
    shared.unpersist()
    return z


def fit_latent(docs: DataFrame, text_col: str = "text", dims: int = DIMS, features: int = FEATURES, rounds: int = ROUNDS, seed: int = SEED) -> LatentModel:
    """The model of a corpus; null texts count as empty ones. Directions beyond
    the corpus's rank (all of them without documents) have strength 0."""
    counted = _counted(docs, text_col, features)
    df, n = _document_frequency(counted, features)
    idf = np.log((n + 1) / (df + 1)) + 1
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, dims)))[0]
    for _ in range(rounds):
        z = _round(counted, idf, v)
        if not z.any():
            return LatentModel(idf, v, np.zeros(dims))
        v = np.linalg.qr(z)[0]
    values, turn = np.linalg.eigh(v.T @ _round(counted, idf, v))
    order = np.argsort(-values)
    return LatentModel(idf, v @ turn[:, order], np.maximum(values[order], 0))


def register_latent(docs: DataFrame, name: str, text_col: str = "text", **kw) -> LatentModel:
    """Fit a model and make it an encoder by ``name`` for ``embed`` and the vector store."""
    model = fit_latent(docs, text_col, **kw)
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.directions, model.strengths))
    encoders.register(name, lambda: LatentModel(*shared.value).encode)
    return model
