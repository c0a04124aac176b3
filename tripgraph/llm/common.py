"""Shared helpers of the training-data operators: table reads, written
intermediate tables, and bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Text bytes handled at once inside a task; one longer text is a slice of its own.
SLICE_BYTES = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, which cuts
    the lineage: a lost executor re-reads parquet instead of recomputing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct column, so that columns added beside
    it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(columns: list[str], row: str = "row") -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in columns]


def large_text(col: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col if pa.types.is_large_string(col.type) else pc.cast(col, pa.large_string())


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without copying; a null has no bytes."""
    col = pc.fill_null(large_text(col), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8) if len(col) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(col) else data, offsets - offsets[0] if len(col) else np.zeros(1, np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of each batch with at most ``most`` bytes of
    ``column``, or a single row."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        at = 0
        while at < b.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield b.slice(at, end - at)
            at = end
