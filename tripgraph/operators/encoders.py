"""Encoders by name: the hook by which any model turns texts into vectors.

An encoder maps a list of texts to an array of equal-length rows. It runs in
Arrow batches inside the tasks (``mapInArrow``); one that is costly to make is
given as a factory and made once in each Python worker.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]

_FACTORIES: dict[str, Callable[[], Encoder]] = {}
_TOKEN = re.compile(r"[^\W_]+")


def register(model: str, factory: Callable[[], Encoder]) -> None:
    """Make ``model`` (a short name without spaces) known to ``embed``."""
    if not model or " " in model:
        raise ValueError("a model's short name has no spaces")
    _FACTORIES[model] = factory


def models() -> list[str]:
    return sorted(_FACTORIES)


def _hashing(dims: int) -> Encoder:
    """Signed token hashing, rows of length one (all zero without tokens)."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in _TOKEN.findall(t.lower()):
                h = zlib.crc32(w.encode())
                out[i, (h >> 1) % dims] += 1 if h & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)

    return encode


register("Hash64", lambda: _hashing(64))
register("Hash256", lambda: _hashing(256))


def embed(docs: DataFrame, text_col: str, model: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, the text and ``embedding`` (array of float) of every
    row, by the registered ``model`` (a display name's part after a space is
    ignored). A null text is encoded as the empty one."""
    short = model.split(" ")[0]
    if short not in _FACTORIES:
        raise KeyError(f"no encoder {short!r}; there are {models()}")
    factory = _FACTORIES[short]
    src = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = factory()
        for b in batches:
            rows = np.asarray(encoder(b.column(len(keep)).to_pylist()), np.float32).reshape(b.num_rows, -1)
            vectors = pa.array(list(rows), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, vectors], [*b.schema.names, "embedding"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in src.dtypes)
    return src.mapInArrow(run, f"{kinds}, embedding array<float>")
