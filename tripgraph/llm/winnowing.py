"""Benchmark decontamination by winnowing.

Fingerprints are the minimal hashes of ``K``-grams in every window of
``WINDOW - K + 1`` consecutive ``K``-grams, the rightmost minimum on ties. A
span of ``WINDOW`` words that a document shares with an item holds one such
window, so both sides keep the same fingerprint at the same place in it: every
shared span of ``WINDOW`` words is found. Documents whose fingerprints occur
among the items' are extended around each hit: all ``WINDOW``-word windows that
cover the fingerprint are compared with the items' windows. Items with fewer
than ``WINDOW`` words are one window of their own length; their lengths (at
most ``WINDOW - 1`` of them) are compared position by position. A window is
compared by two independent hashes of 64 bits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, slices, text_buffer, unpacked, written
from .words import NON_WORD, Words, grams, mix

WINDOW, K = 10, 5
# Windows of all items that are broadcast at most (24 bytes each); beyond it fingerprints are joined by shuffles.
BROADCAST_WINDOWS = 500_000


def fingerprints(words: np.ndarray) -> np.ndarray:
    """Places of the winnowed K-grams of one sequence of at least WINDOW words."""
    g = grams(words, K)
    w = WINDOW - K + 1
    win = np.lib.stride_tricks.sliding_window_view(g, w)
    return np.unique(np.arange(len(win)) + (w - 1 - np.argmin(win[:, ::-1], axis=1)))


def _windows(words: np.ndarray, length: int) -> np.ndarray:
    """Both hashes (one row each) of every window of ``length`` words."""
    if words.shape[1] < length:
        return np.zeros((2, 0), np.uint64)
    return np.stack([mix(grams(row, length) + np.uint64(length)) for row in words])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, length, window, proof, prints) of each distinct window of an
    item: its hashes and the fingerprints that occur in it."""
    for b in slices(batches, "text"):
        w = Words(*text_buffer(b.column(1)), NON_WORD)
        ids, length, window, proof, prints = [], [], [], [], []
        for i in range(b.num_rows):
            words = w.of(i)
            size = min(words.shape[1], WINDOW)
            if not size:
                continue
            h = _windows(words, size).view(np.int64)
            at = fingerprints(words[0]) if size == WINDOW else None
            g = grams(words[0], K) if size == WINDOW else None
            _, first = np.unique(h, axis=1, return_index=True)
            for s in first:
                ids.append(b.column(0)[i].as_py())
                length.append(size)
                window.append(int(h[0, s]))
                proof.append(int(h[1, s]))
                near = [] if at is None else g[at[(at >= s) & (at <= s + WINDOW - K)]].view(np.int64).tolist()
                prints.append(near)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(length, pa.int32()), pa.array(window, pa.int64()), pa.array(proof, pa.int64()), pa.array(prints, pa.list_(pa.int64()))],
            ["item_id", "length", "window", "proof", "prints"])


ITEM_WINDOWS = "item_id bigint, length int, window bigint, proof bigint, prints array<bigint>"


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    src = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_item_windows, ITEM_WINDOWS)


class _Index:
    """The items' windows as sorted arrays: which lengths, fingerprints and
    windows there are, and the items of each window."""

    def __init__(self, rows: pa.Table):
        item, length, window, proof = (rows.column(i).to_numpy() for i in range(4))
        self.lengths = sorted({int(x) for x in length if x < WINDOW})
        prints = rows.column(4).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.prints = np.unique(prints.astype(np.int64).view(np.uint64))
        h, c = (x.astype(np.int64).view(np.uint64) for x in (window, proof))
        order = np.lexsort((item, c, h))
        self.items, h, c = item[order].astype(np.int64), h[order], c[order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))) if len(h) else np.zeros(0, np.int64)
        self.windows, self.proofs = h[new], c[new]
        self.first = np.append(new, len(h))
        # Windows that share their first hash: one, unless it collides.
        self.most = int(np.unique(self.windows, return_counts=True)[1].max()) if len(new) else 0

    def scan(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words are hit, which windows occur) in one document."""
        n = words.shape[1]
        hit, found = np.zeros(n, bool), []
        for length in self.lengths:
            if n >= length:
                self._mark(_windows(words, length), np.arange(n - length + 1), length, hit, found)
        if n >= WINDOW and len(self.prints):
            at = fingerprints(words[0])
            at = at[_member(self.prints, grams(words[0], K)[at])]
            if len(at):
                near = np.unique((at[:, None] - np.arange(WINDOW - K + 1)[None, :]).ravel())
                near = near[(near >= 0) & (near <= n - WINDOW)]
                self._mark(_windows(words, WINDOW), near, WINDOW, hit, found)
        return hit, np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def _mark(self, hashes: np.ndarray, places: np.ndarray, length: int, hit: np.ndarray, found: list) -> None:
        h, c = hashes[:, places]
        maybe = np.flatnonzero(_member(self.windows, h))
        for k in range(self.most):
            at = np.minimum(np.searchsorted(self.windows, h[maybe]) + k, len(self.windows) - 1)
            ok = (self.windows[at] == h[maybe]) & (self.proofs[at] == c[maybe])
            if ok.any():
                start = places[maybe[ok]]
                edge = np.zeros(len(hit) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                hit |= np.cumsum(edge)[:-1] > 0
                found.append(np.unique(at[ok]))

    def items_of(self, windows: np.ndarray) -> list[int]:
        parts = [self.items[self.first[k] : self.first[k + 1]] for k in windows]
        return np.unique(np.concatenate(parts)).tolist() if parts else []


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in slices(batches, "text"):
            w = Words(*text_buffer(b.column(1)), NON_WORD)
            n_hit, items = [], []
            for i in range(b.num_rows):
                hit, windows = index.scan(w.of(i))
                n_hit.append(int(hit.sum()))
                items.append(index.items_of(windows))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(w.counts(), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64()))],
                ["doc_id", "n_words", "n_hit", "items"])

    return run


def _candidates(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (row_id, n_words, print, places, length, windows, proofs): for
        each fingerprint, the windows that cover it; for a short length (print
        null), every window. A document without either gives one bare row."""
        for b in slices(batches, "text"):
            w = Words(*text_buffer(b.column(1)), NON_WORD)
            out = []
            for i in range(b.num_rows):
                words, row = w.of(i), b.column(0)[i].as_py()
                n = words.shape[1]
                out.append((row, n, None, [], 0, [], []))
                for length in lengths:
                    h, c = _windows(words, length).view(np.int64).tolist()
                    out.append((row, n, None, list(range(len(h))), length, h, c))
                if n >= WINDOW:
                    g, (h, c) = grams(words[0], K).view(np.int64), _windows(words, WINDOW).view(np.int64)
                    for p in fingerprints(words[0]).tolist():
                        a, z = max(0, p - WINDOW + K), min(len(h), p + 1)
                        out.append((row, n, int(g[p]), list(range(a, z)), WINDOW, h[a:z].tolist(), c[a:z].tolist()))
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["row_id", "n_words", "print", "places", "length", "windows", "proofs"])

    return run


def _by_shuffles(src: DataFrame, windows: DataFrame) -> DataFrame:
    """The same result for items too many to broadcast: fingerprints semi-join
    the items' fingerprints, the windows around hits join the items' windows."""
    lengths = sorted(r[0] for r in windows.where(F.col("length") < WINDOW).select("length").distinct().collect())
    rows = written(src.withColumn("row_id", F.monotonically_increasing_id()), "decontamination_rows")
    kinds = "row_id bigint, n_words bigint, print bigint, places array<int>, length int, windows array<bigint>, proofs array<bigint>"
    same = ["window", "proof", "length"]
    cand = written(rows.select("row_id", "text").mapInArrow(_candidates(lengths), kinds), "decontamination_windows")
    prints = windows.select(F.explode("prints").alias("print")).distinct()
    near = cand.where("print IS NULL").unionByName(cand.join(prints, "print", "left_semi"))
    spots = near.select("row_id", "length", F.inline(F.arrays_zip(
        F.col("places").alias("place"), F.col("windows").alias("window"), F.col("proofs").alias("proof")))).distinct()
    found = written(spots.join(windows.select(*same).distinct(), same, "left_semi"), "decontamination_spots")
    words = found.select("row_id", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("length") - 1)).alias("word")).distinct()
    hits = words.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.select("row_id", *same).distinct().join(windows.select(*same, "item_id"), same)
    items = items.groupBy("row_id").agg(F.collect_set("item_id").alias("items"))
    sizes = cand.where("length = 0").select("row_id", "n_words")
    return rows.select("row_id", "doc_id").join(sizes, "row_id").join(hits, "row_id", "left").join(items, "row_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def _shared(items: DataFrame, id_col: str, text_col: str, most: int):
    """The items' windows, and a broadcast index of them if they are proven to be at most ``most`` rows."""
    windows = written(item_windows(items, id_col, text_col), "item_windows")
    if windows.limit(most + 1).count() > most:
        return windows, None
    return windows, items.sparkSession.sparkContext.broadcast(_Index(windows.toArrow()))


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without a hit word, with all their columns, judged
    by their text alone. With an index that may be broadcast, texts are judged
    in their row; else rows are numbered, written and joined by number."""
    windows, shared = _shared(items, "item_id", "text", broadcast_windows)
    if shared is not None:

        @F.arrow_udf("boolean")
        def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scan = _scan(shared)
            for t in texts:
                rows = pa.RecordBatch.from_arrays([pa.nulls(len(t), pa.int64()), t], ["doc_id", "text"])
                hits = [b.column(2).to_numpy() for b in scan(iter([rows]))]
                yield pa.array(np.concatenate(hits) == 0 if hits else np.zeros(0, bool))

        return docs.where(clean(F.col(f"`{text_col}`")))
    rows = written(docs.select(packed(docs).alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    hits = _by_shuffles(rows.select(F.col("number").alias("doc_id"), F.col("row").getField(text_col).alias("text")), windows)
    gone = written(hits.where("n_hit > 0").select(F.col("doc_id").alias("number")), "contaminated")
    return rows.join(gone, "number", "left_anti").select(*unpacked(docs.columns))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for every row of ``docs``: its words,
    the words inside an occurrence of any item's window, and the ids of the
    items with such a window.

    Words are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased. Null and empty texts have no words and no hits. Items with a
    null id or without words have no window. Repeated rows give repeated
    results; a repeated item counts once. Other columns are not read. With no
    items, nothing is hit; with no documents, there are no rows.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    windows, shared = _shared(items, item_id_col, item_text_col, broadcast_windows)
    if shared is None:
        return _by_shuffles(src, windows)
    return src.mapInArrow(_scan(shared), "doc_id bigint, n_words bigint, n_hit bigint, items array<bigint>")
