"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are dealt to overlapping shards by their nearest centroids. In each
shard every vector gets edges to near vectors, thinned by robust pruning (an
edge goes if a kept neighbour is much nearer to its end), and edges back. The
lists of a vector from all its shards are united into one flat graph. Every
vector then searches its shards: a beam walks greedily from the shard's medoid,
and from the near vectors it meets (and its own place) the search expands over
all edges while it stays in range. Links are checked by the cosine in double
precision. Recall is audited against brute force on a sample; if it is too low,
the work is done again with more overlap, and at last by exact block pairs.

A shard beyond its size is cut into blocks by hash, each a graph of its own
that all vectors of the shard search, so no task holds an unbounded shard.
Equal vectors are one node with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components
from .pieces import gather

# Centroids are fitted on at most so many vectors (and bytes), smallest id hash first.
SAMPLE, SAMPLE_BYTES = 20_000, 64_000_000
SHARD, BLOCK = 1_000, 2_500  # vectors a centroid, and in one graph at most (about)
CANDIDATES, DEGREE, ALPHA = 64, 24, 1.2
BEAM, SLACK = 12, 0.04
QUERIES = 256  # searched together
OVERLAPS = (2, 4, 8)
# Nodes drawn at first, and linked ones (outside groups of a HUB of all rows) needed among all drawn; least recall.
AUDIT, LINKED, HUB, RECALL = 400, 100, 0.05, 0.95
AUDIT_AT_ONCE = 4_096
EXACT_BLOCK = 2_048


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, vec): bytes of the vector scaled to length one, in double
    precision; null for vectors that link with nothing."""
    for b in batches:
        col = b.column(1)
        flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        size = col.value_lengths().fill_null(0).to_numpy()
        ends = np.cumsum(size)
        out: list[bytes | None] = [None] * len(col)
        for n in np.unique(size[size > 0]):
            at = np.flatnonzero(size == n)
            x = flat[(ends[at] - n)[:, None] + np.arange(n)[None, :]]
            with np.errstate(all="ignore"):
                top = np.abs(x).max(axis=1)
                x = x / top[:, None]
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            for i, ok, v in zip(at, np.isfinite(top) & np.isfinite(x).all(axis=1), x + 0.0):
                out[i] = v.tobytes() if ok else None
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])


def _matrix(col: pa.Array) -> np.ndarray:
    parts = col.to_pylist()
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1) if parts else np.zeros((0, 1))


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means with a fixed seed."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def _assign(shared, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        k = min(overlap, len(c))
        for b in batches:
            if not b.num_rows:
                continue
            near = np.sort(np.argpartition(-(_matrix(b.column(1)) @ c.T), k - 1, axis=1)[:, :k], axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(near.tolist(), pa.list_(pa.int32()))], ["node", "vec", "copies", "shards"])

    return run


def build(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row: robust-pruned edges and edges back."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    c = min(CANDIDATES, n - 1)
    start, end, sim, nearest = [], [], [], []
    for a in range(0, n, QUERIES):
        q = np.arange(a, min(a + QUERIES, n))
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        cand = np.argpartition(-s, c - 1, axis=1)[:, :c]
        to = np.take_along_axis(s, cand, axis=1)
        far = np.sqrt(np.maximum(2 - 2 * to, 0))
        between = np.sqrt(np.maximum(2 - 2 * np.matmul(x[cand], x[cand].transpose(0, 2, 1)), 0))
        nearest.append(np.take_along_axis(cand, to.argmax(axis=1)[:, None], axis=1)[:, 0])
        alive, rows = np.ones_like(cand, bool), np.arange(len(q))
        for _ in range(min(DEGREE, c)):
            pick = np.where(alive, to, -np.inf).argmax(axis=1)
            ok = alive[rows, pick]
            if not ok.any():
                break
            start.append(q[ok])
            end.append(cand[rows, pick][ok])
            sim.append(to[rows, pick][ok])
            alive &= ALPHA * between[rows, pick] > far
            alive[rows, pick] = False
    start, end, sim = np.concatenate(start), np.concatenate(end), np.concatenate(sim)
    order = np.lexsort((-sim, end))  # the nearest DEGREE edges back, and one back from each row's nearest
    rank = np.arange(len(order)) - np.searchsorted(end[order], end[order])
    back = order[rank < DEGREE]
    a, b = np.concatenate([start, end[back], *nearest]), np.concatenate([end, start[back], np.arange(n)])
    pair = np.unique(a * n + b)
    a, b = pair // n, pair % n
    return np.split(b, np.searchsorted(a, np.arange(1, n)))


def search(x: np.ndarray, edges: list[np.ndarray], q: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs with a cosine of at least ``least`` that the search
    finds; own: the query's row, or -1."""
    n, m = len(x), len(q)
    width = 2 * DEGREE  # the walk looks at so many edges of a node, the expansion at all
    pad = np.full((n, width), n, np.int64)
    for i, e in enumerate(edges):
        pad[i, : len(e)] = e[:width]
    degree, ends = np.array([len(e) for e in edges], np.int64), np.concatenate(edges)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    rows = np.arange(m)
    mean = x.mean(axis=0)
    medoid = int((x @ mean).argmax())
    beam, sims = np.full((m, BEAM), n, np.int64), np.full((m, BEAM), -np.inf)
    open_ = np.zeros((m, BEAM), bool)
    beam[:, 0], sims[:, 0], open_[:, 0], seen[:, medoid] = medoid, q @ x[medoid], True, True
    starts = [(rows, np.full(m, medoid), sims[:, 0].copy())]
    while open_.any():
        best = np.where(open_, sims, -np.inf).argmax(axis=1)
        act = np.flatnonzero(open_[rows, best])
        open_[act, best[act]] = False
        nb = pad[beam[act, best[act]]]
        new = ~seen[act[:, None], nb]
        qi, at = np.nonzero(new)
        node, qi = nb[qi, at], act[qi]
        seen[qi, node] = True
        s = np.einsum("ij,ij->i", q[qi], x[node])
        starts.append((qi, node, s))
        wide_n, wide_s = np.full((m, width), n, np.int64), np.full((m, width), -np.inf)
        wide_n[qi, at], wide_s[qi, at] = node, s
        all_n, all_s = np.hstack([beam, wide_n]), np.hstack([sims, wide_s])
        all_o = np.hstack([open_, wide_s > -np.inf])
        top = np.argpartition(-all_s, BEAM - 1, axis=1)[:, :BEAM]
        beam, sims, open_ = (np.take_along_axis(v, top, axis=1) for v in (all_n, all_s, all_o))
    # Range expansion from what the walk met and from each query's own place.
    qi, node, s = (np.concatenate(v) for v in zip(*starts))
    mine = np.flatnonzero((own >= 0) & ~seen[rows, own])
    seen[mine, own[mine]] = True
    qi, node, s = np.concatenate([qi, mine]), np.concatenate([node, own[mine]]), np.concatenate([s, np.ones(len(mine))])
    found = []
    while len(qi):
        near = s >= least - SLACK
        qi, node, s = qi[near], node[near], s[near]
        hit = s >= least
        found.append((qi[hit], node[hit]))
        nb, _ = gather(degree, ends, node)
        qi = np.repeat(qi, degree[node])
        new = ~seen[qi, nb]
        key = np.unique(qi[new] * n + nb[new])
        qi, node = key // n, key % n
        seen[qi, node] = True
        s = np.einsum("ij,ij->i", q[qi], x[node])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _groups(batches: Iterator[pa.RecordBatch], keys: int = 2) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with equal first ``keys`` columns; a run may come in parts."""
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for a, z in zip(cut, cut[1:]):
            yield tuple(k[:, a].tolist()), b.slice(a, z - a)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        node = np.concatenate([p.column(2).to_numpy() for p in parts])
        edges = build(np.concatenate([_matrix(p.column(3)) for p in parts]))
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([node[e].tolist() for e in edges], pa.list_(pa.int64()))], ["node", "near"])

    key, parts = None, []
    for k, part in _groups(batches):
        if k != key:
            if parts:
                yield done(parts)
            key, parts = k, []
        parts.append(part)
    if parts:
        yield done(parts)


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node joined to it) over the pairs."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        np.minimum.at(low, x, low[y])
        np.minimum.at(low, y, low[x])
        low = low[low]
        if (low == before).all():
            return nodes, nodes[low]


def _search(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns: shard, block, kind (0 member, 1 query from another block),
        node, vec, copies, shards, near. Members are queries as well. Gives
        (node, links) and (node, other) rows."""
        key, graph, members = None, None, []

        def ready() -> tuple:
            node = np.concatenate([p.column(3).to_numpy() for p in members])
            x = np.concatenate([_matrix(p.column(4)) for p in members])
            copies = np.concatenate([p.column(5).to_numpy() for p in members])
            shards = np.array([s for p in members for s in p.column(6).to_pylist()])
            place = {v: i for i, v in enumerate(node.tolist())}
            edges = [np.array([place[v] for v in e if v in place], np.int64) for p in members for e in p.column(7).to_pylist()]
            return node, x, copies, shards, place, edges

        def answer(part: pa.RecordBatch) -> pa.RecordBatch:
            node, x, copies, shards, place, edges = graph
            ids = part.column(3).to_numpy()
            own = np.array([place.get(v, -1) for v in ids.tolist()])
            qi, at = search(x, edges, _matrix(part.column(4)), own, least)
            other = ids[qi] != node[at]
            qi, at = qi[other], at[other]
            # A pair counts in the first shard that both are in.
            mine = np.array(part.column(6).to_pylist())
            common = np.where((mine[qi][:, :, None] == shards[at][:, None, :]).any(axis=2), mine[qi], np.iinfo(np.int32).max).min(axis=1) if len(qi) else qi
            counts = np.bincount(qi[common == key[0]], copies[at][common == key[0]], len(ids)).astype(np.int64)
            a, b = _joined(ids[qi], node[at]) if len(qi) else (ids[:0], ids[:0])
            a, b = a[a != b], b[a != b]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids, a]), pa.int64()), pa.array(np.concatenate([counts, np.zeros(len(a), np.int64)]), pa.int64()),
                 pa.array([None] * len(ids) + b.tolist(), pa.int64())], ["node", "links", "other"])

        def answers(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for a in range(0, part.num_rows, QUERIES):
                    yield answer(part.slice(a, QUERIES))

        for k, part in _groups(batches, 3):
            if k[:2] != key:
                if members and graph is None:
                    graph = ready()
                    yield from answers(members)
                key, graph, members = k[:2], None, []
            if k[2] == 0:
                members.append(part)
                continue
            if graph is None:
                graph = ready()
                yield from answers(members)
            yield from answers([part])
        if members and graph is None:
            graph = ready()
            yield from answers(members)

    return run


def _links(nodes: DataFrame, least: float, overlap: int) -> DataFrame:
    """(node, links, other): counts of linked vectors in parts, and joining pairs."""
    spark = nodes.sparkSession
    size, width = nodes.agg(F.count(F.lit(1)), F.max(F.length("vec"))).first()
    some = nodes.orderBy(F.xxhash64("node"), "node").limit(min(SAMPLE, max(64, SAMPLE_BYTES // width))).select("vec").toArrow()
    x = _matrix(some["vec"].combine_chunks())
    k = max(1, min(size // SHARD, len(x) // 4))
    shared = spark.sparkContext.broadcast(centroids(x, k))
    dealt = written(nodes.mapInArrow(_assign(shared, overlap), "node bigint, vec binary, copies bigint, shards array<int>"), "vector_shards")
    each = dealt.select("*", F.explode("shards").alias("shard"))
    blocks = each.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    each = each.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    built = each.select("shard", "block", "node", "vec").repartition("shard", "block").sortWithinPartitions("shard", "block").mapInArrow(
        _build, "node bigint, near array<bigint>")
    flat = written(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vector_graph")
    members = each.join(flat, "node").select("shard", "block", F.lit(0).alias("kind"), "node", "vec", "copies", "shards", "near")
    queries = each.where("blocks > 1").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), F.lit(1).alias("kind"),
        "node", "vec", "copies", "shards", F.lit(None).cast("array<bigint>").alias("near"), "block")
    queries = queries.where("other <> block").drop("block").withColumnRenamed("other", "block").select(*members.columns)
    return members.unionByName(queries).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind").mapInArrow(
        _search(least), "node bigint, links bigint, other bigint")


def _exact(nodes: DataFrame, least: float) -> DataFrame:
    """(node, links, other) of every pair, by blocks of bounded size."""
    blocks = -(-nodes.count() // EXACT_BLOCK)
    own = nodes.select("node", "vec", "copies", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"))
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select(
        F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "vec", "copies")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, ids, copies = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (2, 3, 5))
            x = np.concatenate([_matrix(p.column(4)) for p in parts])
            right = np.flatnonzero(block == key[1])
            left = np.flatnonzero(block == key[0])
            total, u, v = np.zeros(len(ids), np.int64), [], []
            for a in range(0, len(left), QUERIES):
                q = left[a : a + QUERIES]
                near = (x[q] @ x[right].T >= least) & (q[:, None] != right[None, :])
                total[q] += near @ copies[right]
                if key[0] != key[1]:
                    total[right] += copies[q] @ near
                i, j = np.nonzero(near)
                if len(i):
                    n, low = _joined(ids[q[i]], ids[right[j]])
                    u.append(n[n != low])
                    v.append(low[n != low])
            u, v = (np.concatenate([np.zeros(0, np.int64), *w]) for w in (u, v))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids, u]), pa.int64()), pa.array(np.concatenate([total, np.zeros(len(u), np.int64)]), pa.int64()),
                 pa.array([None] * len(ids) + v.tolist(), pa.int64())], ["node", "links", "other"])

        key, parts = None, []
        for k, part in _groups(batches):
            if k != key:
                if parts:
                    yield from links(key, parts)
                key, parts = k, []
            parts.append(part)
        if parts:
            yield from links(key, parts)

    return dealt.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(pairs, "node bigint, links bigint, other bigint")


def _truth(nodes: DataFrame, some: pa.Table, least: float) -> DataFrame:
    """(node, truth): links of some of the nodes by brute force against all."""
    shared = nodes.sparkSession.sparkContext.broadcast((some["node"].to_numpy(), _matrix(some["vec"].combine_chunks())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            if b.num_rows:
                near = (_matrix(b.column(1)) @ x.T >= least) & (b.column(0).to_numpy()[:, None] != ids[None, :])
                total += (near * b.column(2).to_numpy()[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64())], ["node", "truth"])

    return nodes.select("node", "vec", "copies").mapInArrow(count, "node bigint, truth bigint").groupBy("node").agg(F.sum("truth").alias("truth"))


def audit(nodes: DataFrame, links: DataFrame, least: float, sample: int = AUDIT) -> float:
    """Recall of ``links`` (node, links) on a sample of nodes, whose true links
    are counted by brute force against all nodes: the mean over the linked ones
    in which each counts the same, or that in which each group does (a node
    weighs 1 / (1 + links)), whichever is less. Nodes are drawn until LINKED
    linked ones outside the greatest groups are found, or all are drawn."""
    size, rows = nodes.agg(F.count(F.lit(1)), F.sum("copies")).first()
    order = nodes.withColumn("h", F.xxhash64("node", F.lit(1)))
    last, drawn, want, found = None, 0, sample, []
    while drawn < size:
        rest = order if last is None else order.where((F.col("h") > last[0]) | (F.col("h") == last[0]) & (F.col("node") > last[1]))
        some = rest.orderBy("h", "node").limit(min(want, AUDIT_AT_ONCE)).select("h", "node", "vec").toArrow()
        if not some.num_rows:
            break
        last, drawn, want = (some["h"][-1].as_py(), some["node"][-1].as_py()), drawn + some.num_rows, 4 * want
        got = _truth(nodes, some, least).where("truth > 0").join(links, "node", "left").select(
            "truth", F.least(F.coalesce("links", F.lit(0)), "truth").alias("links"))
        found += [(r["truth"], r["links"]) for r in got.collect()]
        if sum(t <= max(1, HUB * rows) for t, _ in found) >= LINKED:
            break
    if not found:
        return 1.0
    truth, got = np.array(found, np.float64).T
    return float(min((got / truth).mean(), np.average(got / truth, weights=1 / (1 + truth))))


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors with a cosine of at least ``least`` are linked; n_links counts the
    other vectors linked directly, component_id is the smallest id reachable,
    kept says whether it is the row's own.

    Null, empty and zero vectors, vectors with null or non-finite components
    and rows with a null id link with nothing and are kept (a null id has a
    null component). Vectors of different lengths never link. Rows that repeat
    an id and vector count as vectors of their own. Other columns are not
    read. An empty table gives no rows.
    """
    src = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = written(src.mapInArrow(_unit, "vec_id bigint, vec binary"), "unit_vectors")
    nodes = written(rows.where("vec IS NOT NULL AND vec_id IS NOT NULL").groupBy("vec").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")).select("node", "vec", "copies"), "vector_nodes")
    parts = []
    # Lengths of vectors: as a rule there is one.
    for (width,) in nodes.select(F.length("vec")).distinct().collect():
        own = nodes.where(F.length("vec") == width)
        for overlap in OVERLAPS:
            part = written(_links(own, least, overlap), "vector_links")
            if audit(own, part.groupBy("node").agg(F.sum("links").alias("links")), least) >= RECALL:
                break
        else:
            part = written(_exact(own, least), "vector_links")
        parts.append(part)
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = parts[0]
    for p in parts[1:]:
        links = links.unionByName(p)
    found = connected_components(links.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")), "vector_components")
    named = nodes.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(found, "node", "left").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = rows.where("vec IS NOT NULL AND vec_id IS NOT NULL").join(named, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
