"""Text encoder and exact nearest-neighbour search.

Encoder (the registered default; dense encoders plug in as any
``(id, embedding ARRAY<FLOAT>)`` table): TF-IDF over lower-cased letter/digit
tokens, smooth idf ``ln((N+1)/(df+1)) + 1``, rows L2-normalised. Built from
split / explode / groupBy / join only.

kNN: queries and corpus are dealt into blocks of bounded size by a hash of
their row number, and every query block meets every corpus block in one task
of ``mapInArrow``. A task returns its block's exact top-k per query (ties:
smaller id first), never all pairs; ``row_number() <= k`` merges the blocks.
Neither table passes through the driver, and no block grows with the data or
with repeats of an id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .patterns import top_k_per

# Token pattern (runs of letters or digits).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

# Rows of a query block and of a corpus block; scores of so many corpus rows are held at once.
QUERY_ROWS, CORPUS_ROWS, SCORE_ROWS = 4096, 8192, 512
# Beyond so many block pairs, blocks of dense vectors are larger (each table travels once per block of
# the other one), up to so many rows and numbers of a block.
BLOCK_PAIRS, MOST_ROWS, MOST_NUMBERS = 1024, 16384, 1 << 21


# ----------------------------------------------------------------------------- TF-IDF
def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token) rows, one per token occurrence."""
    return (
        df.select(F.col(id_col).alias("id"), F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("token"))
        .where(F.col("token") != "")
    )


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return tokens(df, id_col, text_col).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))


def doc_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, toks ARRAY<STRING>): one row per document, empty tokens removed."""
    return df.select(
        F.col(id_col).alias("id"),
        F.filter(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT), lambda t: t != "").alias("toks"),
    )


def fit_idf(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, df, idf) over the corpus (``id_col`` is a document key).

    Document frequency counts each document's *distinct* tokens, so the only
    shuffle is a partial aggregate keyed by token (at most vocabulary x
    partitions rows), never the (document, token) pairs."""
    n_docs = corpus.count()  # one scalar
    return (
        doc_tokens(corpus, id_col, text_col)
        .select(F.explode(F.array_distinct("toks")).alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        .select("token", "df", (F.log(F.lit(n_docs + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    )


def tfidf(df: DataFrame, id_col: str, text_col: str, idf: DataFrame) -> DataFrame:
    """(id, token, weight), L2-normalised per id; tokens unknown to ``idf`` drop out."""
    w = term_counts(df, id_col, text_col).join(idf.select("token", "idf"), "token").withColumn(
        "w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "token", (F.col("w") / F.col("norm")).alias("weight"))


def sparse_rows(weights: DataFrame) -> DataFrame:
    """(id, tokens ARRAY<STRING>, weights ARRAY<DOUBLE>), one row per id."""
    return weights.groupBy("id").agg(
        F.collect_list(F.struct("token", "weight")).alias("tw")
    ).select("id", F.col("tw.token").alias("tokens"), F.col("tw.weight").alias("weights"))


def tfidf_rows(df: DataFrame, id_col: str, text_col: str, idf: DataFrame, idf_max_rows: int = 500_000, dealt: bool = False) -> DataFrame:
    """TF-IDF straight into sparse rows: the L2 norm is computed in the same
    per-document aggregate that collects the terms (no separate norm join).

    When a size check allows the idf table to be broadcast, the documents are
    shuffled once by id; term counts, the idf lookup and the per-document
    collect then all run inside that partitioning (no further exchange).
    Beyond the bound the idf join shuffles on token and the collect on id.
    ``dealt``: rows of an id already stand together, as behind a groupBy."""
    from ..functions.broadcast import is_small

    side = idf.select("token", "idf")
    if is_small(side, idf_max_rows):
        # Shuffle the raw text, so tokenising runs after the exchange, in parallel.
        df, side = df if dealt else df.repartition(F.col(id_col)), F.broadcast(side)
    docs = doc_tokens(df, id_col, text_col)
    tc = docs.select("id", F.explode("toks").alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    w = tc.join(side, "token").select("id", "token", (F.col("tf") * F.col("idf")).alias("w"))
    agg = w.groupBy("id").agg(F.collect_list(F.struct("token", "w")).alias("tw"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return agg.select("id", F.col("tw.token").alias("tokens"),
                      F.transform(F.col("tw.w"), lambda x: x / F.col("norm")).alias("weights"))


# ----------------------------------------------------------------------------- top-k kernels
def _select_top(row: np.ndarray, code: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best candidates of each row (best score, then smallest code)."""
    order = np.lexsort((code, -score, row))
    rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    return order[rank < k]


def _top(scores: Iterator[tuple[int, np.ndarray]], codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, corpus row, score) of each query's k best over score matrices
    (queries x corpus rows from a first one on)."""
    rows, cols, values = [], [], []
    for first, s in scores:
        kk = min(k, s.shape[1])
        order = np.argsort(codes[first : first + s.shape[1]], kind="stable")
        s = s[:, order]
        least = np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk, None]
        # Of equal scores (most are 0) the first by code; no need to sort them all.
        tied = s == least
        tied &= np.cumsum(tied, axis=1, dtype=np.int32) <= k
        r, c = np.nonzero((s > least) | tied)
        best = _select_top(r, c, s[r, c], k)
        back = order[c[best]]
        rows.append(r[best])
        cols.append(first + back)
        values.append(s[r[best], c[best]])
    row, col, value = (np.concatenate(x) for x in (rows, cols, values))
    best = _select_top(row, codes[col], value, k)
    return row[best], col[best], value[best]


def _matrix(parts: list[pa.RecordBatch]) -> np.ndarray:
    lists = pa.chunked_array([p.column(5) for p in parts])
    flat, sizes = pc.list_flatten(lists), pc.unique(pc.list_value_length(lists))
    if lists.null_count or flat.null_count or len(sizes) != 1:
        return np.array(lists.to_pylist(), dtype=np.float64)
    return flat.to_numpy().astype(np.float64).reshape(len(lists), sizes[0].as_py())


def _dense_scores(metric: str, q: np.ndarray, d: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if metric == "cosine":
        q, d = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (q, d))
    step = max(1, min(SCORE_ROWS, 8_000_000 // max(1, q.shape[0] * q.shape[1]) if metric == "l2" else SCORE_ROWS))
    for a in range(0, len(d), step):
        part = d[a : a + step]
        if metric == "cosine":
            yield a, q @ part.T
        else:  # by differences: no cancellation
            diff = q[:, None, :] - part[None, :, :]
            yield a, -np.sqrt(np.einsum("qnd,qnd->qn", diff, diff))


def _nearest(q: np.ndarray, d: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_top`` of the negative L2 distances. Products (|d|^2 - 2qd) with room
    for their rounding rule out what is farther than the k nearest so far; the
    rest is scored by differences. Parts with many ties, and vectors that are
    not finite, are scored by differences alone."""
    with np.errstate(over="ignore", invalid="ignore"):
        qq, dd = np.einsum("qd,qd->q", q, q), np.einsum("nd,nd->n", d, d)
    if not (np.isfinite(qq).all() and np.isfinite(dd).all()):
        return _top(_dense_scores("l2", q, d), codes, k)
    room = 16 * (q.shape[1] + 8) * np.finfo(np.float64).eps * (qq.max() + dd.max())
    most = np.full(len(q), np.inf)  # of |d|^2 - 2qd, for the k nearest
    row, col, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for a in range(0, len(d), SCORE_ROWS):
        part = d[a : a + SCORE_ROWS]
        near = (-2 * q) @ part.T
        near += dd[a : a + SCORE_ROWS]
        if a == 0 and near.shape[1] > k:
            most = np.partition(near, k - 1, axis=1)[:, k - 1] + room
        wanted = near <= (most + room)[:, None]
        if np.count_nonzero(wanted) > max(wanted.size // 8, k * len(q)):
            r, c, v = _top(_dense_scores("l2", q, part), codes[a : a + SCORE_ROWS], k)
        else:
            r, c = np.nonzero(wanted)
            v = np.zeros(len(r))
            for b in range(0, len(r), 1 << 16):
                diff = (q[r[b : b + (1 << 16)]] - part[c[b : b + (1 << 16)]])[None]
                v[b : b + (1 << 16)] = -np.sqrt(np.einsum("qnd,qnd->qn", diff, diff))[0]
        row, col, value = np.concatenate([row, r]), np.concatenate([col, c + a]), np.concatenate([value, v])
        best = _select_top(row, codes[col], value, k)
        row, col, value = row[best], col[best], value[best]
        full = np.bincount(row, minlength=len(q)) >= k
        worst = np.zeros(len(q))
        np.minimum.at(worst, row, value)
        most = np.where(full, np.minimum(most, worst * worst - qq + room), most)
    return row, col, value


def _best_cosine(q: np.ndarray, d: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_top`` of the cosines. Once a query has k candidates, only scores that
    reach its k-th best one so far are looked at; parts with many of them (ties),
    and vectors that are not finite, go the plain way."""
    if not (np.isfinite(q).all() and np.isfinite(d).all()):
        return _top(_dense_scores("cosine", q, d), codes, k)
    row, col, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor, chosen = np.full(len(q), -np.inf), 0
    for a, s in _dense_scores("cosine", q, d):
        wanted = s >= floor[:, None]
        if np.count_nonzero(wanted) > max(wanted.size // 8, k * len(q)):
            r, c, v = _top(iter([(0, s)]), codes[a : a + s.shape[1]], k)
        else:
            r, c = np.divmod(np.flatnonzero(wanted), s.shape[1])
            v = s[r, c]
        row, col, value = np.concatenate([row, r]), np.concatenate([col, c + a]), np.concatenate([value, v])
        if len(row) - chosen >= 2 * len(q) or a + s.shape[1] == len(d):
            best = _select_top(row, codes[col], value, k)
            row, col, value, chosen = row[best], col[best], value[best], len(best)
            least = np.full(len(q), np.inf)
            np.minimum.at(least, row, value)
            floor = np.where(np.bincount(row, minlength=len(q)) >= k, least, -np.inf)
    return row, col, value


def _best_dense(metric: str, queries: list[pa.RecordBatch], corpus: list[pa.RecordBatch], codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, d = _matrix(queries), _matrix(corpus)
    return _nearest(q, d, codes, k) if metric == "l2" else _best_cosine(q, d, codes, k)


def _postings(parts: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(token, row, weight) of each entry of sparse rows."""
    tokens = pa.chunked_array([p.column(5).flatten() for p in parts], pa.string())
    weights = np.concatenate([p.column(6).flatten().to_numpy(zero_copy_only=False) for p in parts])
    sizes = np.concatenate([p.column(5).value_lengths().fill_null(0).to_numpy() for p in parts])
    return tokens, np.repeat(np.arange(len(sizes)), sizes), weights


def _sparse_scores(queries: list[pa.RecordBatch], corpus: list[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Products summed token by token, in the tokens' order, over the tokens
    that both blocks have; rounded, so that no sum's last digits decide a rank."""
    qt, qr, qw = _postings(queries)
    n_queries, n_docs = sum(p.num_rows for p in queries), sum(p.num_rows for p in corpus)
    vocabulary = pc.unique(qt)
    vocabulary = vocabulary.take(pc.sort_indices(vocabulary)) if len(vocabulary) else pa.array([], pa.string())
    dt, dr, dw = _postings(corpus)
    own = pc.index_in(qt, vocabulary).to_numpy()
    hit = pc.index_in(dt, vocabulary).to_numpy(zero_copy_only=False).astype(np.float64)
    known = ~np.isnan(hit)
    hit, dr, dw = hit[known].astype(np.int64), dr[known], dw[known]
    q_order = np.argsort(own, kind="stable")
    q_cut = np.searchsorted(own[q_order], np.arange(len(vocabulary) + 1))
    for a in range(0, n_docs, SCORE_ROWS):
        n = min(SCORE_ROWS, n_docs - a)
        s = np.zeros((n_queries, n))
        here = np.flatnonzero((dr >= a) & (dr < a + n))
        here = here[np.argsort(hit[here], kind="stable")]
        for part in np.split(here, np.flatnonzero(np.diff(hit[here])) + 1) if len(here) else []:
            t = hit[part[0]]
            q = q_order[q_cut[t] : q_cut[t + 1]]
            s[np.ix_(qr[q], dr[part] - a)] += np.outer(qw[q], dw[part])
        yield a, np.round(s, 6)


def _block_rows(n_queries: int, n_docs: int, corpus: DataFrame, query_rows: int, corpus_rows: int) -> tuple[int, int]:
    """Rows of a block of queries and of the corpus, doubled while there are too many pairs."""
    if n_queries * n_docs <= BLOCK_PAIRS * query_rows * corpus_rows:
        return query_rows, corpus_rows
    dims = corpus.agg(F.max(F.size("vec"))).first()[0] or 1
    most = min(MOST_ROWS, MOST_NUMBERS // max(1, dims))
    while n_queries * n_docs > BLOCK_PAIRS * query_rows * corpus_rows and 2 * min(query_rows, corpus_rows) <= most:
        if query_rows <= corpus_rows:
            query_rows *= 2
        else:
            corpus_rows *= 2
    return query_rows, corpus_rows


def _block_pairs(queries: DataFrame, corpus: DataFrame, cols: list[str], query_rows: int, corpus_rows: int) -> DataFrame:
    """(qb, cb, kind, row, id, cols...): both tables dealt to block pairs, the
    queries (kind 0) first. Both are written first: their row numbers must not
    change when a lost task is run again."""
    from ..functions.text import written

    sides = []
    for df, name in ((queries, "knn_queries"), (corpus, "knn_corpus")):
        sides.append(written(df.select("id", *cols).withColumn("row", F.monotonically_increasing_id()), name))
    counts = [df.count() for df in sides]
    if cols == ["vec"]:
        query_rows, corpus_rows = _block_rows(*counts, sides[1], query_rows, corpus_rows)
    nq, nc = (max(1, math.ceil(n / most)) for n, most in zip(counts, (query_rows, corpus_rows)))

    def dealt(df: DataFrame, kind: int) -> DataFrame:
        own, other = (nq, nc) if kind == 0 else (nc, nq)
        block = F.pmod(F.xxhash64("row"), F.lit(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        q, c = (block, every) if kind == 0 else (every, block)
        return df.select(q.alias("qb"), c.alias("cb"), F.lit(kind).alias("kind"), "row", F.col("id").alias("id"), *cols)

    q, c = dealt(sides[0], 0), dealt(sides[1], 1)
    # The two ids may differ in type; each side uses its own column.
    both = q.withColumnRenamed("id", "query_id").unionByName(c.withColumnRenamed("id", "neighbor_id"), allowMissingColumns=True)
    return both.select("qb", "cb", "kind", "row", F.struct("query_id", "neighbor_id").alias("ids"), *cols).repartition("qb", "cb").sortWithinPartitions("qb", "cb", "kind")


def _best_in_blocks(pairs: DataFrame, kinds: tuple[str, str], k: int, best: Callable) -> DataFrame:
    """(query_row, query_id, neighbor_id, score): each query's k best in every
    block pair. ``pairs``: qb, cb, kind, row, ids, the vectors' columns; rows of
    a pair stand together, the queries (kind 0) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            def ids(parts: list[pa.RecordBatch], at: int) -> pa.Array:
                return pa.concat_arrays([p.column(4).field(at) for p in parts])

            own, other = ids(sides[0], 0), ids(sides[1], 1)
            _, codes = np.unique(other.to_numpy(zero_copy_only=False), return_inverse=True)
            row, col, value = best(*sides, codes, k)
            rows = pa.concat_arrays([p.column(3) for p in sides[0]])
            return pa.RecordBatch.from_arrays([rows.take(pa.array(row)), own.take(pa.array(row)), other.take(pa.array(col)), pa.array(value)],
                                              ["query_row", "query_id", "neighbor_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(i).to_numpy() for i in range(3)])
            cut = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for a, z in zip(cut, cut[1:]):
                if (at[0, a], at[1, a]) != key:
                    if sides[0] and sides[1]:
                        yield done()
                    key, sides = (at[0, a], at[1, a]), ([], [])
                sides[at[2, a]].append(b.slice(a, z - a))
        if sides[0] and sides[1]:
            yield done()

    return pairs.mapInArrow(run, f"query_row bigint, query_id {kinds[0]}, neighbor_id {kinds[1]}, score double")


def _knn(queries: DataFrame, corpus: DataFrame, k: int, cols: list[str], best: Callable, query_rows: int, corpus_rows: int) -> DataFrame:
    pairs = _block_pairs(queries, corpus, cols, query_rows, corpus_rows)
    out = _best_in_blocks(pairs, (dict(queries.dtypes)["id"], dict(corpus.dtypes)["id"]), k, best)
    ranked = top_k_per(out, ["query_row"], [F.desc("score"), F.asc("neighbor_id")], k, "pos")
    return ranked.select("query_id", "pos", "neighbor_id", "score")


def knn_dense(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2", query_rows: int = QUERY_ROWS,
              corpus_rows: int = CORPUS_ROWS) -> DataFrame:
    """Exact kNN. ``queries`` and ``corpus``: (id, vec ARRAY<FLOAT|DOUBLE>) of one length.

    Returns (query_id, pos, neighbor_id, score): score is the cosine similarity,
    or the L2 distance for ``l2``; ``pos`` 1..k, best first, ties by smaller id.
    Rows that repeat a query id are answered each."""
    out = _knn(queries, corpus, k, ["vec"], lambda *a: _best_dense(metric, *a), query_rows, corpus_rows)
    return out.withColumn("score", -F.col("score")) if metric == "l2" else out


def knn_sparse(queries: DataFrame, corpus: DataFrame, k: int, query_rows: int = QUERY_ROWS, corpus_rows: int = CORPUS_ROWS) -> DataFrame:
    """Exact kNN on sparse unit vectors (dot product = cosine, ranked after
    rounding to six places). ``queries`` / ``corpus``: (id, tokens
    ARRAY<STRING>, weights ARRAY<DOUBLE>)."""
    return _knn(queries, corpus, k, ["tokens", "weights"], lambda q, c, codes, n: _top(_sparse_scores(q, c), codes, n), query_rows, corpus_rows)


def dedup_by_key(knn: DataFrame, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """Keep the best neighbour per (query, key); neighbours without a key all stay.
    ``keys``: (neighbor_id, key). Positions are renumbered 1..n in rank order."""
    j = knn.join(keys, "neighbor_id", "left")
    keyed = top_k_per(j.where(F.col(key_col).isNotNull()), ["query_id", key_col], [F.asc("pos")], 1, "_r").drop("_r")
    kept = keyed.unionByName(j.where(F.col(key_col).isNull())).withColumnRenamed("pos", "rank_before")
    # Groups hold at most k rows per query.
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("rank_before")))
