"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text. The ordinary one is
trained on windows of ordinary documents. The toxic one holds the same content
and, at its end, the words and word beginnings of toxic documents whose document
counts stand out against ordinary ones (log-likelihood ratio); the ordinary windows
are those without them, so the dictionaries differ in what marks toxic text
and agree on the rest. Every window of a document is compressed with either;
what the toxic dictionary saves is the window's evidence. A document's evidence
(largest, few largest, mean, shares of telling windows) is weighed by ridge
regression and calibrated to a probability, so thresholds follow the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer, written
from .fit import Calibrated, fit, held_out, labelled, matrix
from .words import LOWER, SPACES, Words

WINDOW_WORDS = 6
# The dictionaries are made from at most so many labelled documents of each kind, smallest id hash first; the
# ordinary one from at most so many of their windows, again by hash.
TRAIN_DOCS, TRAIN_WINDOWS = 10_000, 40_000
DICT_BYTES = 65_536
# Word beginnings (in bytes) that may tell toxic text, beside whole words; how many are kept, and from which support and ratio on.
BEGIN = range(5, 9)
MOST_PIECES, SUPPORT, LIFT, RATIO = 2_000, 4, 3, 14.0
LEVEL = 3
RIDGE = 1e-5
THRESHOLD = 0.3


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(lower-cased windows of WINDOW_WORDS words, text of each window); the
    last window of a text may be shorter, a text without words has none."""
    w = Words(data, offsets, SPACES)
    low = LOWER[data].tobytes()
    out, owner = [], []
    for i in range(len(offsets) - 1):
        a, z = int(w.first[i]), int(w.first[i + 1])
        for k in range(a, z, WINDOW_WORDS):
            out.append(low[w.start[k] : w.end[min(k + WINDOW_WORDS, z) - 1]])
            owner.append(i)
    return out, np.array(owner, np.int64)


@dataclass
class Dictionaries:
    ordinary: bytes
    toxic: bytes
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.ordinary, self.toxic

    def __setstate__(self, state):
        self.ordinary, self.toxic = state
        self._made = []

    def evidence(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, for each window."""
        if not self._made:
            for raw in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        a, b = (c.compress for c in self._made)
        return np.array([len(a(b" " + p + b" ")) - len(b(b" " + p + b" ")) for p in parts], np.float64)


def _summary(e: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Evidence of each text from that of its windows; zeros without windows."""
    out = np.zeros((n, 9))
    cut = np.searchsorted(owner, np.arange(n + 1))
    for i in range(n):
        v = e[cut[i] : cut[i + 1]]
        if len(v):
            top = np.sort(v)[::-1]
            out[i] = [top[0] / 10, top[:3].mean() / 10, top[:8].mean() / 10, v.mean() / 10, (v > 0).mean(), (v > 4).mean(),
                      np.log1p((v > 4).sum()), np.log1p((v > 8).sum()), np.log1p(len(v)) / 10]
    return out


class Map:
    """Evidence and its pairwise products, so that a count weighs by length."""

    def __call__(self, x: np.ndarray) -> np.ndarray:
        i, j = np.triu_indices(x.shape[1])
        return np.column_stack([x, x[:, i] * x[:, j]])


def _ordinary_content(parts: list[bytes]) -> bytes:
    """Content of a dictionary trained on the windows; with too little text to train one, the text itself."""
    try:
        raw = zstandard.train_dictionary(DICT_BYTES, parts, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        raw = b" ".join(parts)
    return raw[-(DICT_BYTES - 4096) :] or b" "


def _begins(part: bytes) -> set[bytes]:
    """Beginnings of the window's words, and the words with an end mark."""
    own = part.split()
    return {w[:k] for w in own for k in BEGIN if len(w) >= k} | {w + b" " for w in own}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        parts, owner = windows(*text_buffer(b.column(1)))
        label = b.column(0).to_pylist()
        of: dict[int, set[bytes]] = {}
        for p, i in zip(parts, owner.tolist()):
            of.setdefault(i, set()).update(_begins(p))
        count: dict[tuple[int, bytes], int] = {}
        for i, own in of.items():
            for piece in own:
                count[label[i], piece] = count.get((label[i], piece), 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in count], pa.int32()), pa.array([k[1] for k in count], pa.binary()), pa.array(count.values(), pa.int64())],
            ["label", "piece", "n"])


def _telling(rows: DataFrame, size: dict[int, int]) -> list[bytes]:
    """At most MOST_PIECES words and word beginnings, the most telling last."""
    counts = rows.select("label", "text").mapInArrow(_pieces, "label int, piece binary, n bigint").groupBy("piece").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    n1, n0 = F.lit(float(size[1])), F.lit(float(size[0]))

    def bits(k, n, p):
        return k * F.log(F.greatest(p, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))

    p = (F.col("a") + F.col("b")) / (n0 + n1)
    ratio = 2 * (bits(F.col("a"), n1, F.col("a") / n1) + bits(F.col("b"), n0, F.col("b") / n0) - bits(F.col("a"), n1, p) - bits(F.col("b"), n0, p))
    told = counts.where((F.col("a") >= SUPPORT) & (F.col("a") / n1 > LIFT * F.col("b") / n0)).withColumn("ratio", ratio)
    best = told.where(F.col("ratio") > RATIO).orderBy(F.col("ratio").desc(), "piece").limit(MOST_PIECES).toArrow()
    return best["piece"].to_pylist()[::-1]


def train_dictionaries(docs: DataFrame, labels: DataFrame, label_col: str) -> Dictionaries | None:
    """From at most TRAIN_DOCS documents of each label; None unless both occur."""
    y = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label")).where(~held_out())
    some = [y.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for k in (0, 1)]
    # At most 2 x TRAIN_DOCS short rows, so they may be broadcast whatever the size of the tables.
    rows = written(docs.where("text IS NOT NULL").join(F.broadcast(some[0].unionAll(some[1])), "doc_id").select("label", "text"), "toxicity_sample")
    size = {k: 0 for k in (0, 1)} | {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not all(size.values()):
        return None
    telling = _telling(rows, size)
    known = frozenset(telling)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            parts = [p for p in windows(*text_buffer(b.column(1)))[0] if known.isdisjoint(_begins(p))]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["part"])

    parts = rows.where("label = 0").select(F.lit(0).alias("label"), "text").mapInArrow(cut, "part binary")
    parts = parts.orderBy(F.xxhash64("part"), "part").limit(TRAIN_WINDOWS).toArrow()["part"].to_pylist()
    ordinary = _ordinary_content(parts)
    # zstandard does not index the last 8 bytes, which would be the most telling piece.
    return Dictionaries(ordinary, ordinary + b"".join(b" " + t for t in telling) + b" " * 8)


def _evidence_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            parts, owner = windows(*text_buffer(b.column(1)))
            x = _summary(shared.value.evidence(parts), owner, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                                             ["doc_id", "x"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    score estimates the chance of label 1 from the text alone; predicted is 1
    from 0.3 on. Null, empty and blank texts have no windows and are scored
    from no evidence. Null ids are scored, never held out and never learnt
    from. Repeated rows give repeated results. With no usable labels (none, or
    of one kind) every score is 0. Other columns are not read. An empty table
    gives no rows.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    dictionaries = train_dictionaries(src, labels, label_col)
    if dictionaries is None:
        return src.select("doc_id", held_out().alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    x = written(src.mapInArrow(_evidence_rows(shared), "doc_id bigint, x array<double>"), "toxicity_evidence")
    model = fit(written(labelled(x, labels, label_col), "toxicity_rows"), Map(), RIDGE)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = known.value.score(matrix(b.column(1))) if known.value else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    out = x.mapInArrow(score, "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
