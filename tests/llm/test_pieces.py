"""Encoding, decoding and counting against the sentencepiece library, which is
given the same vocabulary as a unigram model (the file at hand is marked as
another kind; two sentinel scores of -1e9, whose size makes the library's
single-precision sums coarse, are set to an ordinary score on both sides)."""

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tripgraph.llm import pieces, sp_trie, token_count
from tripgraph.llm.queries import op5_sentencepiece_codec, op8_token_count

from . import brute


def raw_model():
    with open(pieces.MODEL, "rb") as f:
        return f.read().replace(struct.pack("<f", -1e9), struct.pack("<f", -31745.0))


def as_unigram(raw):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for field, body in pieces._fields(raw):
        if field == 2:
            body = body.replace(b"\x18\x02", b"\x18\x01", 1)
        out += varint(field << 3 | 2) + varint(len(body)) + body
    return out


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=as_unigram(raw_model()))


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.parse_model(raw_model())


def texts():
    rnd = random.Random(4)
    out = ["", " ", "  ", "a", " a", "a ", "hello world", "a  b   c", "\n", "a\n\nb", "☃ snow", "日本語のテキスト", "\t tab", "é", "🙂🙂", "x" * 300]
    for _ in range(300):
        out.append("".join(rnd.choice("abcdefgh  thein.,\né0") for _ in range(rnd.randint(1, 60))))
    return out


def test_ids_equal_the_librarys(library, vocabulary):
    codec = sp_trie.Codec(vocabulary)
    some = texts()
    ids, cuts = codec.encode(pa.array(some))
    for k, t in enumerate(some):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == library.encode(t), t
    assert codec.decode(ids, cuts) == some


def test_counts_equal_the_librarys(library, vocabulary):
    some = texts()
    assert token_count.Counter(vocabulary).counts(pa.array(some)).tolist() == [len(library.encode(t)) for t in some]


def test_ties_prefer_the_longer_piece():
    v = pieces.Vocabulary([("<unk>", 0.0, 2), ("▁", -1.0, 1), ("a", -1.0, 1), ("b", -1.0, 1), ("ab", -2.0, 1), ("▁a", -2.0, 1), ("▁ab", -3.0, 1), ("c", -9.0, 1)])
    assert sp_trie.Encoder(v).encode_words(["▁ab", "▁", "▁a", "▁ba", "▁z"]) == [[6], [1], [5], [1, 3, 2], [1, 0]]
    c = token_count.Counter(v)
    assert [c.count(w) for w in ("▁ab", "▁", "▁a", "▁ba", "▁z")] == [1, 1, 1, 3, 2]


def test_pieces_across_words_are_refused():
    with pytest.raises(ValueError):
        pieces.Vocabulary([("a▁b", -1.0, 1)])


def test_shared_prefixes_give_what_single_words_give(vocabulary):
    e = sp_trie.Encoder(vocabulary)
    rnd = random.Random(8)
    words = ["▁" + "".join(rnd.choice("aehint") for _ in range(rnd.randint(0, 9))) for _ in range(500)]
    assert e.encode_words(words) == [e.encode_words([w])[0] for w in words]


def test_odd_rows(spark):
    rows = [(1, "a b", 1), (1, "a b", 2), (None, "x", 3), (2, None, 4), (3, "", 5), (4, "▁a", 6), (5, "w" * 30_000 + " v", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sp_trie.encode_documents(df).collect()
    assert sorted((r.decoded, len(r.ids) == 0) for r in got) == sorted([("a b", False), ("a b", False), ("x", False), ("", True), ("", True), (" a", False), ("w" * 30_000 + " v", False)])
    n = token_count.count_tokens(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in n) == sorted((r.doc_id or 0, len(r.ids)) for r in got)
    assert sp_trie.encode_documents(df.limit(0)).collect() == [] and token_count.count_tokens(df.limit(0)).collect() == []
    back = {r.doc_id: r.text for r in sp_trie.decode_ids(sp_trie.encode_documents(df.where("doc_id IN (2, 5)"))).collect()}
    assert back == {2: "", 5: "w" * 30_000 + " v"}


def test_queries_round_trip(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").collect()}
    rows = op5_sentencepiece_codec(spark, brute.SMALL).collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in docs.items()}
    assert {r.doc_id: r.n_tokens for r in op8_token_count(spark, brute.SMALL).collect()} == {r.doc_id: r.n_pieces for r in rows}


def test_gather():
    flat, lengths = np.arange(10), np.array([3, 0, 7])
    values, ends = pieces.gather(lengths, flat, np.array([2, 1, 0, 0]))
    assert values.tolist() == [*range(3, 10), 0, 1, 2, 0, 1, 2] and ends.tolist() == [7, 7, 10, 13]
