"""Filter interaction audit: what each of several filters removes in every
order of application, from one pass over the documents.

Each row gets a mask with one bit per filter that it fails. Only the counts of
the mask cells of a part are needed from there on: a walk through all filter
subsets in Gray-code order toggles one filter at a time, keeps for every cell
the number of active filters that it fails, and adds or takes away the cell
when that counter leaves or reaches zero. The survivors of all subsets are
stored (32 for five filters); a step of any order is the difference of two.

The duplicate filter needs no join of rows with their copies: rows are grouped
by text digest and id first, so a group of copies is reduced before it is
shuffled, and only the row with the smallest id of a digest passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PER_CENT, UPPER_PER_CENT = 50, 65, 5
_BREAK = r"[\x20\x09-\x0D]+"
# Parts whose rows (orders x steps) are built at once.
_PARTS = 64


def text_failures(text: Column) -> list[Column]:
    """Failure conditions A to D of a text; a null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, _BREAK), "")
    n, distinct = F.size(words).cast("bigint"), F.size(F.array_distinct(words)).cast("bigint")
    upper, chars = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint"), F.length(text).cast("bigint")
    return [
        n < MIN_WORDS,
        100 * distinct < DISTINCT_PER_CENT * n,
        100 * upper > UPPER_PER_CENT * chars,
        text.rlike("[#$%&*|]"),
    ]


def _bits(failures: list[Column]) -> Column:
    mask = F.lit(0)
    for k, fails in enumerate(failures):
        mask = mask + F.when(fails, 1 << k).otherwise(0)
    return mask


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters that they
    fail. Rows without an id have no labels and are no copies of others; rows
    that repeat an id and text are not copies of each other. A document is good
    (toxic) if any of its label rows says so."""
    facts = written(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        _bits(text_failures(F.col("text"))).alias("mask"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    ), "filter_facts")
    named = facts.where("doc_id IS NOT NULL").groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    copy = F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    rows = named.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left").select(
        "part", (F.col("mask") + copy).alias("mask"), "n", "good", "bad")
    nameless = facts.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select(
        "part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("bad"))
    return rows.unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("toxic"))


def subset_survivors(cells: np.ndarray, filters: int) -> np.ndarray:
    """Survivors of every filter subset: ``cells`` (parts, 2 ** filters, counts)
    to (2 ** filters, parts, counts), by the Gray-code walk."""
    masks = np.arange(1 << filters)
    active = np.zeros(1 << filters, np.int64)
    alive = cells.sum(axis=1)
    states = np.empty((1 << filters, *alive.shape), np.int64)
    states[0] = alive
    for step in range(1, 1 << filters):
        gray, toggled = step ^ (step >> 1), (step & -step).bit_length() - 1
        failing = (masks >> toggled & 1).astype(bool)
        if gray >> toggled & 1:
            alive = alive - cells[:, failing & (active == 0)].sum(axis=1)
            active[failing] += 1
        else:
            active[failing] -= 1
            alive = alive + cells[:, failing & (active == 0)].sum(axis=1)
        states[gray] = alive
    return states


def _steps(letters: str):
    """Per row of a part's report: order, step, filter, subsets before and after."""
    rows = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, f in enumerate(order):
            rows.append(("".join(letters[k] for k in order), step + 1, f, before, before | 1 << f))
            before |= 1 << f
    names, step, f, before, after = zip(*rows)
    return list(names), *(np.array(x) for x in (step, f, before, after))


def order_report(cells: DataFrame, letters: str = FILTERS) -> DataFrame:
    """All orders and steps of each part of ``cells`` (part, mask, n, good,
    toxic); a part's cells are at most 2 ** len(letters) rows. No part, no row."""
    width = 1 << len(letters)
    per_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in counts)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, step, f, before, after = _steps(letters)
        names, full = pa.array(names), width - 1
        for b in batches:
            for at in range(0, b.num_rows, _PARTS):
                part, lists = b.column(0)[at : at + _PARTS], b.column(1)[at : at + _PARTS]
                n = len(part)
                row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                table = np.zeros((n, width, 3), np.int64)
                table[row, flat.field(0).to_numpy()] = np.stack([flat.field(k).to_numpy() for k in (1, 2, 3)], axis=1)
                state = subset_survivors(table, len(letters)).transpose(1, 0, 2)
                lost = state[:, before] - state[:, after]
                fails = state[:, :1, 0] - state[:, 1 << f, 0]
                shapley = np.stack([lost[:, f == k, 0].sum(axis=1) for k in range(len(letters))], axis=1)
                values = (state[:, after, 0], lost[:, :, 0], fails - lost[:, :, 0], state[:, full ^ (1 << f), 0] - state[:, [full], 0],
                          lost[:, :, 1], lost[:, :, 2], shapley[:, f])
                yield pa.RecordBatch.from_arrays(
                    [part.take(pa.array(np.repeat(np.arange(n), len(step)))), pa.concat_arrays([names] * n), pa.array(np.tile(step, n), pa.int32()),
                     *(pa.array(v.reshape(-1), pa.int64()) for v in values)],
                    names=["part", "filter_order", "step", *counts])

    return per_part.mapInArrow(walk, schema)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (a source; null and empty: the empty string), order of
    the five filters and step: documents kept after the step, removed in it,
    failing its filter but removed earlier, failing its filter only, good and
    toxic ones removed in it, and the filter's removals over all orders. An
    empty table has no parts and no rows; parts where nothing fails have zeros.
    Other columns of ``docs`` play no part."""
    return order_report(failure_cells(docs, labels))
