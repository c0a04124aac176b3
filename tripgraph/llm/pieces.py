"""Vocabularies of SentencePiece models and marked words of whole texts.

A vocabulary's pieces and scores are read from the model file's bytes, so a task
needs neither the file nor the library. Texts are cut before each run of spaces
into marked words (the run and what follows it): pieces hold the space mark only
at their start, so no piece crosses a cut and words can be treated one by one.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from .common import large_text

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        if c < 128:
            return value, i
        shift += 7


def _fields(b: bytes):
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            size, i = _varint(b, i)
            value, i = b[i : i + size], i + size
        else:
            size = 4 if kind == 5 else 8
            value, i = b[i : i + size], i + size
        yield tag >> 3, value


@dataclass
class Vocabulary:
    """pieces: text, score and type by id. Scores are log weights of a unigram
    model; unknown characters score the least score less UNKNOWN_PENALTY and
    become byte pieces where the vocabulary has them."""

    pieces: list[tuple[str, float, int]]

    def __post_init__(self):
        self._made: dict = {}
        normal = [s for _, s, t in self.pieces if t == NORMAL]
        if not normal:
            raise ValueError("the vocabulary has no normal piece")
        for p, _, t in self.pieces:
            if t in (NORMAL, USER_DEFINED) and MARK in p.lstrip(MARK):
                raise ValueError(f"piece {p!r} crosses words")
        self.unknown_score = min(normal) - UNKNOWN_PENALTY
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}

    def kept(self, kind):
        """The ``kind`` (an encoder, a counter) made from this vocabulary; made
        once, not sent with it."""
        if kind not in self._made:
            self._made[kind] = kind(self)
        return self._made[kind]

    def __getstate__(self):
        return self.__dict__ | {"_made": {}}

    def texts(self) -> dict[str, tuple[int, float]]:
        """(id, score) of the pieces that match text; the earliest id of equal ones."""
        top = max(s for _, s, t in self.pieces if t == NORMAL)
        out: dict[str, tuple[int, float]] = {}
        for i, (p, s, t) in enumerate(self.pieces):
            if t == NORMAL:
                out.setdefault(p, (i, s))
            elif t == USER_DEFINED:
                out.setdefault(p, (i, len(p) * top - 0.1))
        return out

    def spell(self, char: str) -> list[int]:
        """Ids of a character that no piece covers."""
        raw = char.encode("utf-8", "surrogatepass")
        return [self.bytes[x] for x in raw] if len(self.bytes) == 256 else [self.unknown]

    def surface(self, i: int) -> bytes:
        p, _, t = self.pieces[i]
        if t == BYTE:
            return bytes([int(p[1:-1], 16)])
        if t == CONTROL:
            return b""
        return " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode()


def parse_model(raw: bytes) -> Vocabulary:
    pieces = []
    for field, value in _fields(raw):
        if field == 1:
            text, score, kind = "", 0.0, NORMAL
            for f, v in _fields(value):
                if f == 1:
                    text = v.decode()
                elif f == 2:
                    score = struct.unpack("<f", v)[0]
                elif f == 3:
                    kind = v
            pieces.append((text, score, kind))
    return Vocabulary(pieces)


def load_model(spark: SparkSession, path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file: from the driver's disk, or from any
    store that Spark reads if the path has a scheme."""
    if "://" in path:
        return parse_model(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    with open(path, "rb") as f:
        return parse_model(f.read())


def marked_words(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word number of each word, first word of each text).

    Every non-empty text is given a leading space, then cut before each run of
    spaces; a null or empty text has no words. Words keep plain spaces where a
    model has marks, so that cutting and comparing need no copies.
    """
    col = pc.fill_null(large_text(col), "")
    full = pc.not_equal(col, "")
    col = pc.if_else(full, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), col, pa.scalar(" ", pa.large_string())), col)
    # The mark is a space once it is normalised, so both are cut alike.
    if pc.any(pc.match_substring(col, MARK)).as_py():
        col = pc.replace_substring(col, MARK, " ")
    col = large_text(col)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = data == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    start[edge] = True
    cuts = np.append(np.flatnonzero(start), len(data)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data)))
    coded = words.dictionary_encode()
    first = np.searchsorted(cuts[:-1], offsets)
    return coded.dictionary, coded.indices.to_numpy(), first


def gather(lengths: np.ndarray, flat: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``numbers`` of ``flat`` (run k has lengths[k]
    values): (values, end of each run)."""
    begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    size = lengths[numbers]
    ends = np.cumsum(size)
    if not len(ends):
        return flat[:0], ends
    at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(begin[numbers], size)
    return flat[at], ends
