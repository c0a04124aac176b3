"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The distinct marked words of a slice of texts are sorted and so lie as in a
trie; they are walked depth first. At each character the forward scores of all
prefixes so far are known, and going on to the next word keeps those of the
prefix that both share. Ids of all words are then put together per text.

Ties follow the library: of equal scores the piece that starts first (the
longest) wins, since a later start replaces an end only with a greater score.
Scores are summed in double precision and per word, where no piece crosses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import MARK, MODEL, Vocabulary, gather, load_model, marked_words


# Larger slices repeat fewer words but take more memory: 3 MB of text some 100 MB in a worker, 8 MB some 300 MB.
SLICE = 3_000_000


class Encoder:
    """Viterbi over words in sorted order, one character at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.root: dict = {}
        for text, (i, score) in vocabulary.texts().items():
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node[""] = (i, score)

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each of the ascending ``words`` (with marks)."""
        root, unknown, spell = self.root, self.vocabulary.unknown_score, self.vocabulary.spell
        # By depth: best score, its last piece (start, id or -1), and the open matches (start, trie node).
        best, back, open_ = [0.0], [(0, -1)], [[(0, root)]]
        before = ""
        for word in words:
            depth, shared = 0, min(len(before), len(word))
            while depth < shared and before[depth] == word[depth]:
                depth += 1
            del best[depth + 1 :], back[depth + 1 :], open_[depth + 1 :]
            for d in range(depth, len(word)):
                c, top, last, onward = word[d], None, None, []
                single = False
                for start, node in open_[d]:
                    node = node.get(c)
                    if node is not None:
                        onward.append((start, node))
                        hit = node.get("")
                        if hit is not None:
                            score = best[start] + hit[1]
                            single = single or start == d
                            if top is None or score > top:
                                top, last = score, (start, hit[0])
                if not single:
                    score = best[d] + unknown
                    if top is None or score > top:
                        top, last = score, (d, -1)
                best.append(top)
                back.append(last)
                onward.append((d + 1, root))
                open_.append(onward)
            ids: list[int] = []
            at = len(word)
            while at:
                start, i = back[at]
                if i < 0:
                    ids.extend(reversed(spell(word[start])))
                else:
                    ids.append(i)
                at = start
            before = word
            yield ids[::-1]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        for k, ids in zip(order, self.encode_sorted([words[k] for k in order])):
            out[k] = ids
        return out


class Codec:
    """Encoder and decoder of batches; built once for a broadcast vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.encoder = Encoder(vocabulary)
        surface = [vocabulary.surface(i) for i in range(len(vocabulary.pieces))]
        self.size = np.array([len(s) for s in surface], np.int64)
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end)."""
        words, numbers, first = marked_words(texts)
        ids = self.encoder.encode_words([w.replace(" ", MARK) for w in words.to_pylist()])
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.int32)
        values, ends = gather(lengths, flat, numbers)
        return values, np.concatenate(([0], ends))[first]

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """Texts of id sequences: the space before a text's first word goes."""
        values, ends = gather(self.size, self.bytes, ids)
        at = np.concatenate(([0], ends))[cuts]
        raw = values.tobytes()
        texts = (raw[a:z] for a, z in zip(at[:-1], at[1:]))
        return [(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts]


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.kept(Codec)
        for b in slices(batches, "text", SLICE):
            ids, cuts = codec.encode(b.column(1))
            col = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), col, pa.array(codec.decode(ids, cuts), pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``docs``: the piece ids of its
    text and the text they stand for.

    A text is marked (a space is put before it, spaces become marks) and not
    normalised otherwise; a mark in the text decodes as a space, every other
    text decodes to itself. Null and empty texts have no ids and decode to the
    empty text. Characters without a piece become byte pieces. Repeated rows
    and null ids are carried. Other columns are not read. An empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_model(docs.sparkSession, model))
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_encode(shared), "doc_id bigint, ids array<int>, decoded string")


def decode_ids(rows: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of stored piece ids; null or empty ids give the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(load_model(rows.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.kept(Codec)
        for b in batches:
            ids = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.concatenate(([0], np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codec.decode(ids, cuts), pa.string())], ["doc_id", "text"])

    src = rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, "doc_id bigint, text string")
