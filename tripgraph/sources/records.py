"""CSV records of files that are read in many ranges, line breaks in quotes
included.

Spark's text source reads the lines of a file by byte ranges. Whether a range
begins inside quotes depends on all quotes before it, so the first pass counts
quotes per range and sums them up over the ranges (a small table); the second
one knows the parity at each range's beginning and cuts the lines of the range
into records. A record that crosses ranges leaves a piece in each, and only
these pieces are brought together. No pass needs more than a batch of lines at
a time, or one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.broadcast import is_small
from ..functions.text import written

# What a piece is: a record, the end (or middle) of one that began in an earlier range, the beginning of one that goes on.
WHOLE, LATER, OPEN = 0, 1, 2


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, range, parity, value), the lines of a range in order, to (file,
    position, kind, record). A position is the range's first byte and the number
    of lines before, so positions ascend through a file."""
    key, parity, held, kind, at, seen = None, 0, [], WHOLE, 0, 0
    names = ["file", "position", "kind", "record"]

    def cut(positions: list[int], kinds: list[int], records: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(records), pa.string()), pa.array(positions, pa.int64()), pa.array(kinds, pa.int32()), pa.array(records, pa.string())], names)

    def rest() -> Iterator[pa.RecordBatch]:
        """What is held at the end of a range."""
        if held:
            yield cut([at], [LATER if kind == LATER else OPEN], ["\n".join(held)])

    for b in batches:
        if not b.num_rows:
            continue
        file, where, start, value = b.column(0), b.column(1).to_numpy(), b.column(2), b.column(3)
        codes = file.dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero((where[1:] != where[:-1]) | (codes[1:] != codes[:-1])) + 1).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:]):
            own = (file[a].as_py(), int(where[a]))
            if own != key:
                yield from rest()
                key, parity, held, seen = own, int(start[a].as_py()), [], 0
                kind = LATER if parity else WHOLE
            lines = value.slice(a, z - a)
            after = (parity + np.cumsum(pc.count_substring(lines, '"').to_numpy())) % 2
            lines, begun, positions, kinds, records = lines.to_pylist(), 0, [], [], []
            for e in np.flatnonzero(after == 0).tolist():  # lines that end a record
                at = at if held else own[1] + seen + begun
                positions.append(at)
                kinds.append(kind)
                records.append("\n".join([*held, *lines[begun : e + 1]]))
                held, kind, begun = [], WHOLE, e + 1
            if begun < len(lines):
                at = at if held else own[1] + seen + begun
                held += lines[begun:]
            parity, seen = int(after[-1]), seen + len(lines)
            yield cut(positions, kinds, records)
    yield from rest()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, record, closed) of every record, without the line break
    at its end; blank records are left out. Positions order a file's records.
    ``closed`` is false for a last record whose quotes are not balanced; it
    holds the rest of the file. Quotes stand at the ends of fields, or doubled
    in quoted ones; one inside a field without quotes would be taken for a
    quote that opens."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "range").agg(F.sum(quotes).alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of a file
    ranges = written(counts.select("file", "range", F.pmod(F.coalesce(F.sum("quotes").over(earlier), F.lit(0)), F.lit(2)).cast("int").alias("parity")), "csv_ranges")
    if is_small(ranges):
        known = lines.join(F.broadcast(ranges), ["file", "range"])
    else:  # a shuffle mixes the lines of a range
        numbered = lines.withColumn("line", F.monotonically_increasing_id())
        known = numbered.join(ranges, ["file", "range"]).repartition("file", "range").sortWithinPartitions("file", "range", "line")
    pieces = written(known.select("file", "range", "parity", "value").mapInArrow(_cut, "file string, position bigint, kind int, record string"), "csv_pieces")
    order = Window.partitionBy("file").orderBy("position")  # at most two pieces a range
    cross = pieces.where(F.col("kind") != WHOLE).withColumn("number", F.sum((F.col("kind") == OPEN).cast("int")).over(order))
    joined = cross.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("position", "record"))).alias("p")).select(
        "file", F.col("p")[0]["position"].alias("position"), F.array_join("p.record", "\n").alias("record"))
    every = pieces.where(F.col("kind") == WHOLE).select("file", "position", "record").unionByName(joined)
    every = every.withColumn("record", F.regexp_replace("record", "\r$", ""))
    n = F.length("record") - F.length(F.replace("record", F.lit('"'), F.lit("")))
    return every.where("record <> ''").withColumn("closed", n % 2 == 0)
