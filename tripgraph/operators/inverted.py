"""Exact nearest neighbours of sparse vectors by an inverted index.

``build_index`` deals documents into blocks of bounded size, neighbours in the
order of their heaviest token, so that a block's documents share what makes
them special, and writes one posting per token and block: the documents, their
weights and the greatest of them. A token of most documents is thereby split
into as many postings as there are blocks. ``index_texts`` does so for the
TF-IDF rows of texts, encoded and cut where they are read: nothing is dealt
again, and blocks share their heaviest tokens within one partition.

``knn_inverted`` asks every query against few blocks:

1. Seeds: the blocks with the greatest weights of the query's strongest tokens
   are scored; the k-th best score found is a floor of the final one.
2. Bounds: tokens whose greatest contributions, even together, stay below the
   floor cannot lift a document over it alone. A block is only looked up by the
   other tokens, and is a candidate if its greatest weights, with all that the
   skipped tokens could add, reach the floor. All other blocks are skipped.
3. Candidates are scored exactly, block by block, and the best k of each query
   are merged. Queries that share a token with fewer than k documents are
   filled up with the smallest ids, at a score of 0.

Queries meet a block in slices of bounded size; the postings travel to the
slices of their block, the corpus never to each block of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.broadcast import checked_broadcast, is_small
from ..functions.text import written
from .patterns import top_k_per
from .vectors import _select_top, doc_tokens, tfidf_rows

# Documents of a block, queries that meet a block at once, tokens whose best block is scored first.
BLOCK_DOCS, SLICE_QUERIES, SEEDS = 1024, 2048, 4
# Scores are ranked after rounding to this many places; bounds leave twice as much room.
PLACES = 6
_ROOM = 2 * 10.0**-PLACES
# Blocks of one partition are numbered from partition * this.
_STRIDE = 1 << 24
# Tokens that every task may hold with their idf.
VOCABULARY_ROWS = 2_000_000
# Queries' tokens that are broadcast to pick the postings that anyone asks for.
ASKED_ROWS = 1_000_000
_POSTING = "block bigint, token string, top double, rows array<int>, weights array<double>, ids array<{}>"


@dataclass
class InvertedIndex:
    postings: DataFrame  # block, token, top, rows, weights; token '' of a block: its ids, ascending
    tokens: DataFrame    # token, top, block: the greatest weight of a token and where it is
    first_ids: DataFrame  # the smallest ids: fill for queries without enough documents
    fill: int
    repeats: bool = False  # whether one document may stand in several blocks


def _block(number: int, ids: pa.Array, row: np.ndarray, code: np.ndarray, weight: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """The postings of a block: an entry per (row, code of a token), ``words``
    the tokens by code. Rows are numbered anew in the order of their ids."""
    by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    place = np.empty(len(by_id), np.int32)
    place[by_id] = np.arange(len(by_id), dtype=np.int32)
    row = place[row]
    order = np.lexsort((row, code))
    row, code, weight = row[order], code[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    cut = np.append(first, len(code)).astype(np.int32)
    top = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
    n = len(first)
    # The header row first: the ids of the block's documents.
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n + 1, number)), pa.concat_arrays([pa.array([""]), words.take(pa.array(code[first])).cast(pa.string())]), pa.array(np.concatenate(([0.0], top))),
        pa.ListArray.from_arrays(np.concatenate(([0], cut)).astype(np.int32), pa.array(row, pa.int32())),
        pa.ListArray.from_arrays(np.concatenate(([0], cut)).astype(np.int32), pa.array(weight)),
        pa.ListArray.from_arrays(np.array([0] + [len(ids)] * (n + 1), np.int32), ids.take(pa.array(by_id))),
    ], ["block", "token", "top", "rows", "weights", "ids"])


def _in_blocks(batches: Iterator[pa.RecordBatch], block_docs: int, block: Callable[[int, pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block`` of every ``block_docs`` rows of a partition and of the rest."""
    number, parts, n = TaskContext.get().partitionId() * _STRIDE, [], 0
    for b in batches:
        t = pa.Table.from_batches([b])
        while t.num_rows:
            take = min(block_docs - n, t.num_rows)
            parts.append(t.slice(0, take))
            t, n = t.slice(take), n + take
            if n == block_docs:
                yield block(number, pa.concat_tables(parts).combine_chunks())
                parts, n, number = [], 0, number + 1
    if parts:
        yield block(number, pa.concat_tables(parts).combine_chunks())


def _cut_blocks(block_docs: int):
    def block(number: int, t: pa.Table) -> pa.RecordBatch:
        lists = t.column("tokens").combine_chunks()
        weight = t.column("weights").combine_chunks().flatten().to_numpy()
        row = np.repeat(np.arange(t.num_rows, dtype=np.int32), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        words = lists.flatten().dictionary_encode()
        return _block(number, t.column("id").combine_chunks(), row, words.indices.to_numpy(), weight, words.dictionary)

    return lambda batches: _in_blocks(batches, block_docs, block)


def _token_codes(vocabulary):
    """(id, main, codes) of (id, toks): a code per token, ascending, and that of
    the heaviest token; documents without a token drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, idf = vocabulary.value
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            known = pc.fill_null(pc.index_in(flat.dictionary, words), -1).to_numpy()
            code = known[flat.indices.to_numpy()] if len(row) else np.zeros(0, np.int64)
            row, code = row[code >= 0], code[code >= 0]
            if not len(row):
                continue
            key = np.sort(row * len(words) + code)
            row, code = key // len(words), key % len(words)
            # The heaviest token: of the greatest count times idf, then the last.
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            w = np.diff(np.append(first, len(key))) * idf[code[first]]
            order = np.lexsort((code[first], w, row[first]))
            last = np.flatnonzero(np.append(np.diff(row[first][order]) != 0, True))
            cut = np.append(np.flatnonzero(np.concatenate(([True], np.diff(row) != 0))), len(row)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row[cut[:-1]])), pa.array(code[first][order][last], pa.int32()), pa.ListArray.from_arrays(cut, pa.array(code, pa.int32()))],
                ["id", "main", "codes"])

    return run


def _cut_texts(vocabulary, block_docs: int):
    """Postings of (id, codes) in the order of the heaviest token and the id; of
    neighbours with one id the first is taken."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            if b.num_rows:
                ids = b.column(0)
                new = np.ones(b.num_rows, bool)
                new[1:] = pc.not_equal(ids.slice(1), ids.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
                new[0] = before is None or ids[0].as_py() != before
                before = ids[-1].as_py()
                yield b.filter(pa.array(new))

    def block(number: int, t: pa.Table) -> pa.RecordBatch:
        words, idf = vocabulary.value
        lists = t.column("codes").combine_chunks()
        row = np.repeat(np.arange(t.num_rows, dtype=np.int64), pc.list_value_length(lists).to_numpy())
        key, tf = np.unique(row * len(words) + lists.flatten().to_numpy(), return_counts=True)
        row, code = key // len(words), key % len(words)
        w = tf * idf[code]
        w /= np.sqrt(np.bincount(row, w * w, t.num_rows))[row]
        return _block(number, t.column("id").combine_chunks(), row, code, w, words)

    return lambda batches: _in_blocks(once(batches), block_docs, block)


def _smallest(n: int):
    """The n smallest distinct values of a partition, nulls first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            own = pc.unique(b.column(0) if best is None else pa.concat_arrays([best, b.column(0)]))
            best = own.take(pc.sort_indices(own, null_placement="at_start")[:n])
        if best is not None:
            yield pa.RecordBatch.from_arrays([best], ["id"])

    return run


def build_index(rows: DataFrame, fill: int = 100, block_docs: int = BLOCK_DOCS) -> InvertedIndex:
    """Index of ``rows`` (id, tokens ARRAY<STRING>, weights ARRAY<DOUBLE>, no
    negative ones), written to the shared folder. ``fill``: the greatest k that
    will be asked for. Null arrays are empty ones. ``rows`` is read a few times
    and best a written table."""
    rows = rows.select(
        "id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"),
        F.coalesce("weights", F.array().cast("array<double>")).alias("weights"))
    heaviest = F.array_max(F.arrays_zip(F.col("weights").alias("w"), F.col("tokens").alias("t")))["t"]
    dealt = rows.withColumn("main", F.coalesce(heaviest, F.lit(""))).repartitionByRange("main", "id").sortWithinPartitions("main", "id")
    kind = dict(rows.dtypes)["id"]
    return _indexed(dealt.select("id", "tokens", "weights").mapInArrow(_cut_blocks(block_docs), _POSTING.format(kind)), kind, fill, False)


def index_texts(docs: DataFrame, idf: DataFrame, fill: int = 100, block_docs: int = BLOCK_DOCS, vocabulary_rows: int = VOCABULARY_ROWS) -> InvertedIndex:
    """Index of the TF-IDF rows of ``docs`` (id, text; rows that repeat an id,
    which is not null, hold the same text) by ``idf`` (token, idf). Each
    partition encodes its documents and cuts them into blocks, without an
    exchange, so a document may stand in a block of several partitions. Beyond
    ``vocabulary_rows`` tokens rows are encoded by joins and dealt."""
    if not is_small(idf, vocabulary_rows):
        one = docs.groupBy("id").agg(F.any_value("text").alias("text"))
        return build_index(written(tfidf_rows(one, "id", "text", idf, dealt=True), "index_rows"), fill, block_docs)
    vocabulary = idf.select("token", "idf").toArrow()  # at most ``vocabulary_rows``
    vocabulary = vocabulary.take(pc.sort_indices(vocabulary.column("token"))).combine_chunks() if vocabulary.num_rows else vocabulary
    words = pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in vocabulary.column("token").chunks)])
    shared = docs.sparkSession.sparkContext.broadcast((words, vocabulary.column("idf").to_numpy()))
    kind = dict(docs.dtypes)["id"]
    coded = doc_tokens(docs, "id", "text").mapInArrow(_token_codes(shared), f"id {kind}, main int, codes array<int>")
    cut = coded.sortWithinPartitions("main", "id").select("id", "codes").mapInArrow(_cut_texts(shared, block_docs), _POSTING.format(kind))
    return _indexed(cut, kind, fill, True)


def _indexed(cut: DataFrame, kind: str, fill: int, repeats: bool) -> InvertedIndex:
    postings = written(cut, "index_postings")
    tokens = written(postings.where("token <> ''").groupBy("token").agg(
        F.max("top").alias("top"), F.max_by("block", F.struct("top", "block")).alias("block")), "index_tokens")
    ids = postings.where("token = ''").select(F.explode("ids").alias("id"))
    first_ids = written(ids.mapInArrow(_smallest(2 * fill), f"id {kind}").distinct().orderBy("id").limit(2 * fill), "index_first_ids")
    return InvertedIndex(postings, tokens, first_ids, fill, repeats)


def _score_blocks(k: int, kinds: tuple[str, str]):
    """Exact best k of each query among a block's documents with a score above
    0: products summed token by token in the tokens' order, then rounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, postings, queries = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            p, q = pa.Table.from_batches(postings), pa.Table.from_batches(queries)
            ids = p.filter(pc.equal(p.column("token"), "")).column("ids").combine_chunks().flatten()
            words = p.column("token").combine_chunks()
            rows, weights = p.column("rows").combine_chunks(), p.column("weights").combine_chunks()
            cut, flat_rows, flat_weights = rows.offsets.to_numpy(), rows.flatten().to_numpy(), weights.flatten().to_numpy()
            cut = cut - cut[0]
            lists = q.column("q_tokens").combine_chunks()
            owner = np.repeat(np.arange(q.num_rows), pc.list_value_length(lists).to_numpy())
            at = pc.index_in(lists.flatten(), words).to_numpy(zero_copy_only=False).astype(np.float64)
            known = np.flatnonzero(~np.isnan(at))
            at, owner, own = at[known].astype(np.int64), owner[known], q.column("q_weights").combine_chunks().flatten().to_numpy()[known]
            names = words.take(pa.array(at))
            order = np.lexsort((owner, pc.rank(names, tiebreaker="dense").to_numpy())) if len(at) else at
            at, owner, own = at[order], owner[order], own[order]
            s = np.zeros((q.num_rows, len(ids)))
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(at) else []:
                a, z = cut[at[part[0]]], cut[at[part[0]] + 1]
                s[np.ix_(owner[part], flat_rows[a:z])] += np.outer(own[part], flat_weights[a:z])
            s = np.round(s, PLACES)
            row, col = np.nonzero(s > 0)
            best = _select_top(row, col, s[row, col], k)  # rows stand in the order of their ids
            row, col = row[best], col[best]
            yield pa.RecordBatch.from_arrays(
                [q.column("query_row").combine_chunks().take(pa.array(row)), ids.take(pa.array(col)), pa.array(s[row, col])],
                ["query_row", "neighbor_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(i).to_numpy() for i in range(2)])
            side = b.column(2).to_numpy()
            cut = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0) | (side[1:] != side[:-1])) + 1).tolist(), b.num_rows]
            for a, z in zip(cut, cut[1:]):
                if (at[0, a], at[1, a]) != key:
                    if postings and queries:
                        yield from done()
                    key, postings, queries = (at[0, a], at[1, a]), [], []
                (queries if side[a] else postings).append(b.slice(a, z - a))
        if postings and queries:
            yield from done()

    return run


def _scored(pairs: DataFrame, queries: DataFrame, index: InvertedIndex, k: int, slice_queries: int) -> DataFrame:
    """(query_row, neighbor_id, score) of the pairs (query_row, block)."""
    sizes = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / slice_queries).cast("int").alias("slices"))
    sizes = checked_broadcast(written(sizes, "index_block_slices"))
    dealt = pairs.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("query_row"), F.col("slices")).cast("int"))
    q = dealt.join(queries, "query_row").select("block", "part", F.lit(1).alias("side"), "query_row", "q_tokens", "q_weights")
    # Of the postings only those of tokens that a query has, and the ids.
    asked = queries.select(F.explode(F.array_append("q_tokens", F.lit(""))).alias("token")).distinct()
    asked = checked_broadcast(written(asked, "index_asked"), ASKED_ROWS)
    p = index.postings.join(sizes, "block").join(asked, "token", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "block", "part", F.lit(0).alias("side"), "token", "rows", "weights", "ids")
    both = p.unionByName(q, allowMissingColumns=True).repartition("block", "part").sortWithinPartitions("block", "part", "side")
    kind = dict(index.first_ids.dtypes)["id"]
    found = both.mapInArrow(_score_blocks(k, ("bigint", kind)), f"query_row bigint, neighbor_id {kind}, score double")
    return found.dropDuplicates(["query_row", "neighbor_id"]) if index.repeats else found


def knn_inverted(queries: DataFrame, index: InvertedIndex, k: int, seeds: int = SEEDS, slice_queries: int = SLICE_QUERIES,
                 stats: dict | None = None) -> DataFrame:
    """(query_id, pos, neighbor_id, score) of the k best documents of each
    query: by the product of the vectors rounded to six places, then by id.
    ``queries``: (id, tokens, weights), no negative weights, a token once a row;
    rows that repeat an id are answered each. ``stats`` gets the numbers of
    (query, block) pairs: ``all``, ``scored`` and ``skipped``."""
    if k > index.fill:
        raise ValueError(f"the index was built for at most {index.fill} neighbours")
    q = written(queries.select(
        F.monotonically_increasing_id().alias("query_row"), F.col("id").alias("query_id"),
        F.coalesce("tokens", F.array().cast("array<string>")).alias("q_tokens"), F.coalesce("weights", F.array().cast("array<double>")).alias("q_weights")), "index_queries")
    terms = q.select("query_row", F.inline(F.arrays_zip(F.col("q_tokens").alias("token"), F.col("q_weights").alias("w"))))
    known = terms.join(index.tokens, "token").select("query_row", F.struct((F.col("w") * F.col("top")).alias("most"), "token", "w", "block").alias("term"))
    plan = written(known.groupBy("query_row").agg(F.sort_array(F.collect_list("term"), asc=False).alias("terms")), "index_plan")
    first = written(plan.select("query_row", F.explode(F.array_distinct(F.transform(F.slice("terms", 1, seeds), lambda t: t["block"]))).alias("block")), "index_seeds")
    found = written(_scored(first, q.drop("query_id"), index, k, slice_queries), "index_seed_scores")
    kth = top_k_per(found, ["query_row"], [F.desc("score"), F.asc("neighbor_id")], k, "pos").where(F.col("pos") == k)
    floor = kth.select("query_row", F.col("score").alias("floor"))

    # What a term and all weaker ones could give; the floor cuts the list.
    limits = plan.join(floor, "query_row", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - _ROOM)
    total = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["most"])
    steps = F.aggregate(
        "terms", F.struct(total.alias("left"), F.array().cast("array<double>").alias("from_here")),
        lambda acc, t: F.struct((acc["left"] - t["most"]).alias("left"), F.concat(acc["from_here"], F.array(acc["left"])).alias("from_here")))["from_here"]
    limits = limits.select("query_row", "floor", "terms", total.alias("total"), steps.alias("from_here"))
    limits = limits.withColumn("n", F.size(F.filter("from_here", lambda s: s >= F.col("floor"))))
    rest = F.coalesce(F.get("from_here", F.col("n")), F.lit(0.0))
    strong = limits.select("query_row", "floor", "total", rest.alias("rest"), F.explode(F.slice("terms", 1, F.col("n"))).alias("t")).select(
        "query_row", "floor", "rest", F.col("t.token").alias("token"), F.col("t.w").alias("w"), (F.col("total") - F.col("t.most")).alias("others"))
    tops = index.postings.where("token <> ''").select("token", "block", "top")
    near = strong.join(tops, "token").where("others + w * top >= floor")
    reach = near.groupBy("query_row", "block").agg(F.sum(F.col("w") * F.col("top")).alias("sum"), F.first("rest").alias("rest"), F.first("floor").alias("floor"))
    wanted = written(reach.where("sum + rest >= floor").select("query_row", "block").join(first, ["query_row", "block"], "left_anti"), "index_wanted")
    if stats is not None:
        blocks = index.postings.where("token = ''").count()
        stats["all"], stats["scored"] = q.count() * blocks, first.count() + wanted.count()
        stats["skipped"] = stats["all"] - stats["scored"]
    hits = found.unionByName(_scored(wanted, q.drop("query_id"), index, k, slice_queries))
    hits = hits.dropDuplicates(["query_row", "neighbor_id"]) if index.repeats else hits
    best = written(top_k_per(hits, ["query_row"], [F.desc("score"), F.asc("neighbor_id")], k, "pos"), "index_best")

    # Queries with fewer than k documents go on with the smallest other ids.
    short = q.select("query_row").join(best.groupBy("query_row").count().where(F.col("count") >= k), "query_row", "left_anti")
    spare = F.array(*[F.lit(r[0]) for r in index.first_ids.collect()])  # at most 2 * fill ids
    zero = short.select("query_row", F.explode(spare).alias("neighbor_id"), F.lit(0.0).alias("score"))
    zero = zero.join(best.select("query_row", "neighbor_id"), ["query_row", "neighbor_id"], "left_anti")
    filled = best.select("query_row", "neighbor_id", "score").unionByName(zero)
    ranked = top_k_per(filled, ["query_row"], [F.desc("score"), F.asc("neighbor_id")], k, "pos")
    return ranked.join(q.select("query_row", "query_id"), "query_row").select("query_id", "pos", "neighbor_id", "score")
