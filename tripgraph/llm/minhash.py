"""MinHash near-duplicate removal with fast similarity sketching.

A document's set holds its distinct word shingles. Its sketch has ``BINS``
coordinates, filled in rounds: round i places every shingle in one hashed bin
with the value (i, hash), and a bin keeps its smallest value, so a later round
only fills what earlier rounds left empty. If ``BINS`` rounds leave a gap, one
more round a bin places every shingle in just that bin: every coordinate of a
non-empty set is filled. A few rounds do for large sets, since n shingles throw
n balls a round.

Sketches are cut into bands; equal bands make documents candidates. Candidate
classes are joined to coarse components, whose full sets meet in blocks of
bounded size; each block pair compares its sets exactly and returns its linked
groups as edges to their smallest member, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.broadcast import checked_broadcast
from .common import slices, text_buffer, written
from .components import connected_components
from .words import SPACES, Words, grams, mix

SHINGLE = 5
BINS = 256
# Coordinates a band: as many up to ROWS as miss a pair at the threshold with a probability of at most MISS.
ROWS, MISS = 8, 1e-4
# A block of full sets: at most about so many sets and elements.
BLOCK_SETS, BLOCK_ELEMENTS = 256, 1_000_000
# Candidate ids are broadcast up to this count (some 20 MB); beyond it the join shuffles.
BROADCAST_IDS = 500_000
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_BIN_BITS, _ROUND_BITS = np.uint64(8), np.uint64(8)
_VALUE = np.uint64((1 << 48) - 1)


def sketch(x: np.ndarray) -> np.ndarray:
    """The ``BINS`` coordinates of a non-empty array of distinct hashes."""
    out = np.zeros(BINS, np.uint64)
    empty = np.ones(BINS, bool)
    at, n = 0, len(x)
    while at < BINS and empty.any():
        rounds = min(BINS - at, max(1, int(empty.sum() * 7 / n) + 1))
        h = mix(x[None, :] ^ _SEEDS[at : at + rounds, None])
        # (bin, round, value) in one number: the first of each bin in order is its minimum.
        key = (h & ~np.uint64((1 << 56) - 1)) | (np.arange(rounds, dtype=np.uint64) << np.uint64(48))[:, None] | (h & _VALUE)
        key = np.sort(key, axis=None)
        bins = (key >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        got, value = bins[first], key[first]
        new = empty[got]
        out[got[new]] = (value[new] & _VALUE) | ((((value[new] >> np.uint64(48)) & np.uint64(255)) + np.uint64(at)) << np.uint64(48))
        empty[got] = False
        at += rounds
    for b in np.flatnonzero(empty):
        out[b] = mix(x ^ _SEEDS[BINS + b]).min() & _VALUE | np.uint64(255) << np.uint64(48)
    return out


def band_rows(per_cent: int) -> int:
    """8 (32 bands, missing 4e-5) for 85, 6 (42 bands, missing 3e-6) for 80."""
    return next((r for r in range(ROWS, 1, -1) if (1 - (per_cent / 100) ** r) ** (BINS // r) <= MISS), 1)


def bands(coords: np.ndarray, n_rows: int = ROWS) -> np.ndarray:
    rows = coords[: len(coords) // n_rows * n_rows].reshape(-1, n_rows)
    h = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for j in range(n_rows):
        h = mix(h ^ rows[:, j]) + np.uint64(j)
    return h


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(grams(words, SHINGLE))


def _sketches(n_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Words(*text_buffer(b.column(1)), SPACES)
            n, key, band = [], [], []
            for i in range(b.num_rows):
                s = shingle_set(w.hash[w.first[i] : w.first[i + 1]])
                n.append(len(s))
                if len(s):
                    key.append(np.array([mix(s).sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes())
                    band.append(bands(sketch(s), n_rows).view(np.int64))
                else:
                    key.append(None)
                    band.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "set_key", "bands"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        w = Words(*text_buffer(b.column(1)), SPACES)
        sets = [shingle_set(w.hash[w.first[i] : w.first[i + 1]]).tobytes() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "elements"])


def overlaps(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all intersections of the sets, by products of 0/1 matrices over
    ``chunk`` shared elements at a time."""
    if not sets:
        return np.zeros((0, 0), np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.concatenate(([True], every[1:] != every[:-1])) if len(every) else np.zeros(0, bool)
    at = np.cumsum(new) - 1
    shared = np.bincount(at)[at] > 1 if len(every) else new
    row, at = row[shared], at[shared]
    col = np.cumsum(np.concatenate(([True], at[1:] != at[:-1]))) - 1 if len(at) else at
    out = np.zeros((len(sets), len(sets)), np.int64)
    cuts = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else -1) + chunk, chunk))
    for a, z in zip(cuts, [*cuts[1:], len(col)]):
        if z > a:
            m = np.zeros((len(sets), chunk), np.float32)
            m[row[a:z], col[a:z] % chunk] = 1
            out += (m @ m.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def stars(nodes: list[int], pairs: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node of its group) for every other node of the groups
    that the index pairs join."""
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(int(a)), find(int(b))
        if x != y:
            low, high = (x, y) if nodes[x] < nodes[y] else (y, x)
            root[high] = low
    return [(nodes[i], nodes[find(i)]) for i in range(len(nodes)) if root[i] != i]


def _verify(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, side, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            size = np.array([len(s) for s in sets])
            both = overlaps(sets)
            a, b = np.nonzero(np.triu(100 * both >= per_cent * (size[:, None] + size[None, :] - both), 1))
            if key is not None and key[1] != key[2]:
                s = np.array(side)
                a, b = a[s[a] != s[b]], b[s[a] != s[b]]
            found = stars(nodes, np.stack([a, b], 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            elements = batch.column(5)
            for i, (comp, bi, bj, own, node) in enumerate(zip(*cols)):
                if (comp, bi, bj) != key:
                    if len(nodes) > 1:
                        yield links()
                    key, nodes, side, sets = (comp, bi, bj), [], [], []
                nodes.append(node)
                side.append(own)
                sets.append(np.frombuffer(elements[i].as_py(), np.uint64))
        if len(nodes) > 1:
            yield links()

    return run


def near_duplicates(docs: DataFrame, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row of
    ``docs``; text_hash (xxhash64) tells rows that repeat an id apart.

    Documents are linked if their sets of distinct 5-word shingles (words:
    runs of non-white-space, A-Z lower-cased) have a similarity of at least
    ``per_cent`` / 100, checked on the full sets. component_id is the smallest
    id reachable by links, kept says whether it is the row's own.

    Null and empty texts and texts without words have an empty set, link with
    nothing and are kept. With fewer than five words the whole sequence is the
    one shingle. Rows with a null id take part under no component: their
    component_id is null and kept is true. Repeated rows give repeated results.
    Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    kinds = "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, bands array<bigint>"
    sk = written(src.mapInArrow(_sketches(band_rows(per_cent)), kinds), "sketches")

    # One class per distinct set: exact copies never meet in pairs.
    classes = written(sk.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands")), "classes")
    buckets = classes.select("node", F.explode("bands").alias("band"))
    heads = buckets.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = buckets.join(heads.select("band", "head"), "band").where("node <> head")
    coarse = connected_components(near.select(F.col("node").alias("u"), F.col("head").alias("v")), "coarse")

    # Blocks of bounded size; a component of many blocks meets in block pairs.
    members = coarse.join(classes.select("node", "n"), "node")
    blocks = members.groupBy("component").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    members = written(members.join(blocks, "component").select(
        "node", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")).distinct(), "members")
    ids = checked_broadcast(members.select(F.col("node").alias("doc_id")), BROADCAST_IDS)
    texts = src.drop("text_hash").join(ids, "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "node bigint, elements binary").dropDuplicates(["node", "elements"])
    dealt = members.join(sets, "node").select(
        "component", "block", "node", "elements", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("component", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
                         "block", "node", "elements")
    links = dealt.repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj").mapInArrow(
        _verify(per_cent), "u bigint, v bigint")
    found = connected_components(written(links, "links"), "near")

    named = classes.select("set_key", "node").join(found, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("component"))
    out = sk.drop("bands").join(named, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    component = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")
