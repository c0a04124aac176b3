"""Merkle manifest of a table: a tree of SHA-256 digests per group and one over
the groups' roots, and proofs that a recursive query climbs.

Leaves are ranked within their group without a window over a whole group: a
range partitioning sorts them, each partition numbers its rows, and the counts
per partition (a small table) are summed up to the positions that it starts at.
Every eight consecutive nodes are reduced to their parent, level by level, and
each level is written.

A stored node row is a *rung*: the digests of its children in one binary, and
the link to its parent (its place in the next level and its slot there). The
recursive query starts at every leaf, joins the rung above, appends the
siblings found there as one row of its result, folds the digest and goes on
until a rung has no parent. All leaves of a group end in the same few rungs, so
a rung is stored once for each chunk of ``CHUNK`` consecutive leaves below it:
no join key ever has more than ``CHUNK`` leaves, and the copies are at most one
row per level and chunk.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.broadcast import checked_broadcast
from .common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
# Leaves that share one copy of a rung: a power of the arity.
CHUNK_LEVELS = 4
CHUNK = ARITY**CHUNK_LEVELS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW_LIMIT, _LEVEL_LIMIT = "spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit"

# The climb. overlay() puts the folded digest in the place of the node's own
# one; what is left of the rung without that place are the siblings.
_CLIMB = """
WITH RECURSIVE climb(tree, pos, level, go, slot, fold, siblings) AS (
  SELECT tree, pos, 0, go, slot, fold, X'' FROM {walkers}
  UNION ALL
  SELECT c.tree, c.pos, r.level, r.go, r.slot,
         unhex(sha2(lower(hex(overlay(r.children PLACING c.fold FROM c.slot * 32 + 1 FOR 32))), 256)),
         concat(substring(r.children, 1, c.slot * 32), substring(r.children, c.slot * 32 + 33))
  FROM climb c JOIN {rungs} r ON c.tree = r.tree AND c.pos div {chunk} = r.chunk AND c.level + 1 = r.level AND c.go = r.at
)
SELECT tree, pos,
       sha2(array_join(transform(array_sort(collect_list(struct(level, siblings))), x -> lower(hex(x.siblings))), ''), 256) AS proof_sha256,
       lower(hex(max_by(fold, level))) AS folded_root
FROM climb GROUP BY tree, pos"""


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (hex) of the fields in turn, each its UTF-8 byte count, a colon and its value, or a dash if null."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts), 256)


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes until one is left, in whole numbers."""
    return sum((n > ARITY**k).cast("int") for k in range(21))


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``rank``, sizes): the rank of each row in its group by
    ``order`` from 0, and the table (group, size). ``order`` must end in a
    column that tells all rows apart, so that no range is too large."""
    cut = written(
        rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (group, *order)])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (group, *order)])
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    counts = cut.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    counts.createOrReplaceTempView(view := f"_ranked_{uuid.uuid4().hex}")
    # One row per partition and group: at most as many as partitions and groups together.
    starts = written(cut.sparkSession.sql(
        f"SELECT _part, `{group}` AS _group, _n, COALESCE(sum(_n) OVER (PARTITION BY `{group}` ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        f" - _first AS _shift FROM {view}"), f"{name}_starts")
    cut.sparkSession.catalog.dropTempView(view)
    near = checked_broadcast(starts.select(F.col("_part").alias("_p"), "_group", "_shift"))
    out = cut.join(near, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group"))).withColumn("rank", F.col("_at") + F.col("_shift"))
    sizes = starts.groupBy(F.col("_group").alias(group)).agg(F.sum("_n").alias("size"))
    return out.drop("_part", "_at", "_p", "_group", "_shift"), sizes


def build_levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Levels 1 and up of all trees over ``nodes`` (tree, height, pos, digest):
    tables (tree, height, pos, digest, children), a tree ending at its height."""
    levels, top = [], nodes.agg(F.max("height")).first()[0] or 0
    for level in range(1, top + 1):
        runs = nodes.where(F.col("height") >= level).groupBy("tree", "height", F.expr(f"pos div {ARITY}").alias("pos")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("run"))
        text = runs.select("tree", "height", "pos", F.array_join(F.transform("run", lambda x: F.lower(F.hex(x.digest))), "").alias("text"))
        nodes = written(text.select("tree", "height", "pos", F.unhex(F.sha2("text", 256)).alias("digest"), F.unhex("text").alias("children")),
                        f"{name}_level_{level}")
        levels.append(nodes)
    return levels


def _above(level: int, pos: Column, height: Column, tree: Column, top: int) -> list[Column]:
    """Link of the node ``pos`` of ``level`` (a tree's own levels, then those over the trees): place in the next level, slot there."""
    inside = F.lit(level) < height
    here = F.when(inside, pos).when(F.lit(top > 0), tree)
    return [F.floor(here / ARITY).cast("bigint").alias("go"), (here % ARITY).cast("int").alias("slot")]


def build_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", tampered: dict[str, Column] | None = None):
    """(leaves, rungs, trees, root) over the rows of ``docs``.

    ``leaves``: key, tree, height, pos, leaf and tampered (binary digests; the
    second with the columns of ``tampered`` in place of the table's).
    ``rungs``: tree, chunk, level, at, children, go, slot. ``trees``: tree (the
    group's place in bytewise order, null first), height, chunks, subroot.
    ``root``: hex, None for an empty table. Rows that repeat a key stand in the
    order of their leaf digests; a null key comes first."""
    fields = list(fields)
    cols = [F.col(f"`{f}`") for f in fields]
    changed = [(tampered or {}).get(f, F.col(f"`{f}`")) for f in fields]
    hashed = written(docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").cast("string").alias("grp"), F.unhex(leaf_digest(cols)).alias("leaf"),
        F.unhex(leaf_digest(changed)).alias("tampered"), F.monotonically_increasing_id().alias("row")), "leaves")
    placed, sizes = ranked(hashed, "grp", ["key", "leaf", "row"], "placed")
    groups, _ = ranked(sizes.withColumn("all", F.lit(0)), "all", ["grp"], "groups")
    trees = written(groups.select("grp", F.col("rank").alias("tree"), _height(F.col("size")).alias("height"),
                                  F.ceil(F.col("size") / CHUNK).cast("bigint").alias("chunks")), "trees")
    leaves = written(placed.join(checked_broadcast(trees.select(F.col("grp").alias("g"), "tree", "height")), F.col("grp").eqNullSafe(F.col("g")))
                     .select("key", "tree", "height", F.col("rank").alias("pos"), "leaf", "tampered"), "manifest_leaves")
    inner = build_levels(leaves.select("tree", "height", "pos", F.col("leaf").alias("digest")), "tree")
    tops = [leaves.where("height = 0").select("tree", F.col("leaf").alias("digest"))]
    tops += [t.where(F.col("height") == level).select("tree", "digest") for level, t in enumerate(inner, 1)]
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    n_trees = trees.count()
    top = sum(n_trees > ARITY**k for k in range(21))
    subroots = written(subroots.withColumn("height", F.lit(top)), "subroots")
    outer = build_levels(subroots.select(F.lit(-1).cast("bigint").alias("tree"), "height", F.col("tree").alias("pos"), "digest"), "top")
    last = (outer[-1] if outer else subroots).select(F.lower(F.hex("digest"))).first()

    small = checked_broadcast(trees.select("tree", "chunks"))
    rungs = []
    for level, t in enumerate(inner, 1):
        link = _above(level, F.col("pos"), F.col("height"), F.col("tree"), top)
        if level <= CHUNK_LEVELS:
            rung = t.withColumn("chunk", F.expr(f"pos div {ARITY ** (CHUNK_LEVELS - level)}"))
        else:
            below = ARITY ** (level - CHUNK_LEVELS)
            rung = t.join(small, "tree").withColumn("chunk", F.explode(F.sequence(F.col("pos") * below, F.least((F.col("pos") + 1) * below, F.col("chunks")) - 1)))
        rungs.append(rung.select("tree", "chunk", F.lit(level).alias("level"), F.col("pos").alias("at"), "children", *link))
    for step, t in enumerate(outer, 1):
        under = trees.select("tree", "height", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"),
                             F.expr(f"tree div {ARITY ** step}").alias("at"))
        link = [F.floor(F.col("at") / ARITY).cast("bigint").alias("go"), (F.col("at") % ARITY).cast("int").alias("slot")]
        if step == top:
            link = [F.lit(None).cast("bigint").alias("go"), F.lit(None).cast("int").alias("slot")]
        rungs.append(under.join(checked_broadcast(t.select(F.col("pos").alias("at"), "children")), "at")
                     .select("tree", "chunk", (F.col("height") + step).alias("level"), "at", "children", *link))
    ladder = docs.sparkSession.createDataFrame([], "tree bigint, chunk bigint, level int, at bigint, children binary, go bigint, slot int")
    for r in rungs:
        ladder = ladder.unionByName(r)
    ladder = written(ladder, "rungs")
    named = written(trees.join(checked_broadcast(subroots.select("tree", F.col("digest").alias("subroot"))), "tree"), "manifest_trees")
    return leaves, ladder, named, last[0] if last else None, top


def climb(leaves: DataFrame, rungs: DataFrame, top: int, digest: str = "tampered") -> DataFrame:
    """(tree, pos, proof_sha256, folded_root) of every leaf by the recursive
    query. The rows of a recursion are limited by a setting of the session
    which knows nothing of the table's size; it is lifted while the result is
    written and put back."""
    spark = leaves.sparkSession
    views = {k: f"_{k}_{uuid.uuid4().hex}" for k in ("walkers", "rungs")}
    leaves.select("tree", "pos", *_above(0, F.col("pos"), F.col("height"), F.col("tree"), top), F.col(digest).alias("fold")).createOrReplaceTempView(views["walkers"])
    rungs.hint("shuffle_hash").createOrReplaceTempView(views["rungs"])
    before = {k: spark.conf.get(k) for k in (_ROW_LIMIT, _LEVEL_LIMIT)}
    try:
        for k in before:
            spark.conf.set(k, "-1")
        return written(spark.sql(_CLIMB.format(**views, chunk=CHUNK)), "proofs")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for v in views.values():
            spark.catalog.dropTempView(v)


def tamper_audit(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` and what tampering does to it: in rows where 3
    divides crc32(doc_id), A-Z of the text are changed to lower case after the
    tree was built, and every row's proof is climbed with its digest as it is
    then.

    Columns: doc_id, leaf, subroot, root, proof_sha256 (of the untampered
    tree), folded_root, verified. A row without an id is not tampered with, nor
    is a null text. A group's only leaf is its subroot, an only subroot the
    root; a proof without siblings is the digest of the empty string. An empty
    table gives an empty result; other columns of ``docs`` play no part."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    leaves, rungs, trees, root, top = build_manifest(docs, tampered={"text": text})
    proofs = climb(leaves, rungs, top)
    subroots = checked_broadcast(trees.select("tree", "subroot"))
    rows = leaves.join(proofs, ["tree", "pos"]).join(subroots, "tree")
    root_ = F.lit(root).cast("string")
    return rows.select(F.col("key").alias("doc_id"), F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), root_.alias("root"),
                       "proof_sha256", "folded_root", (F.col("folded_root") == root_).alias("verified"))
