"""Line dedup: lines that several documents share stay in one of them only.

Lines are exploded with their position and reduced to a 128-bit hash of the
normalised line; documents are counted per hash, and the positions to drop are
brought back to their documents, whose other lines are joined again in order.
Line texts are never shuffled, only hashes and positions; the document itself
travels once, to meet its positions.

A hash that many documents hold is split twice: its documents are counted with
partial sums per (hash, document), and its lines are marked by a broadcast of
the frequent hashes alone. A hash is frequent if it holds more than one in
``FREQUENT`` of all (hash, document) pairs, so there are fewer than
``FREQUENT`` of them whatever the size of the table. The others are joined by
a shuffle in which none is larger than that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_CHARS, MIN_DOCS = 10, 2
FREQUENT = 10_000
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows without an id count as one document behind all others.
_NO_ID = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _short_hash(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _row_key(docs: DataFrame) -> list[Column]:
    """Rows that share an id and text lose the same lines, so these two name a row."""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("who"), _short_hash(F.col("whole")).alias("version")]


def document_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(who, version, at, h) of every line whose key has ``min_chars`` code points or more."""
    whole = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("whole"))
    # The row's key is made before its lines are exploded: once, not for each line.
    rows = whole.select(*_row_key(whole), F.split("whole", "\n", -1).alias("parts"))
    lines = rows.select("who", "version", F.posexplode("parts").alias("at", "line"))
    keys = lines.select("who", "version", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("who", "version", "at", _short_hash(F.col("key")).alias("h"))


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h, n_docs, owner) of every hash in ``min_docs`` documents or more; owner has the smallest id."""
    pairs = lines.groupBy("h", "who").agg(F.count(F.lit(1)).alias("times"))
    return pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.min("who").alias("owner")).where(F.col("n_docs") >= min_docs)


def dropped_lines(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """(who, version, at) of the lines to drop; both tables are written ones."""
    pairs = shared.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.col("n_docs") * FREQUENT > pairs
    frequent = F.broadcast(shared.where(hot).select("h", "owner"))
    marked = lines.join(frequent, "h", "left")
    by_broadcast = marked.where("owner < who")
    by_shuffle = marked.where("owner IS NULL").drop("owner").join(shared.where(~hot).select("h", "owner"), "h").where("owner < who")
    return by_broadcast.select("who", "version", "at").unionAll(by_shuffle.select("who", "version", "at"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row: its number of lines,
    how many go, and the text of the others.

    A null or empty text is one empty line. Lines with a key of ``min_chars``
    code points or more go if ``min_docs`` documents or more hold the key,
    except from the one with the smallest id, which keeps all of its own. Rows
    that repeat an id are one document when documents are counted; so are all
    rows without an id, which come after every id. An empty table gives an
    empty result; other columns of ``docs`` play no part."""
    lines = written(document_lines(docs, min_chars), "lines")
    shared = written(shared_lines(lines, min_docs), "shared_lines")
    drops = dropped_lines(lines, shared).groupBy("who", "version").agg(F.collect_set("at").alias("gone"))
    whole = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("whole"))
    found = whole.select("doc_id", "whole", *_row_key(whole)).join(drops.hint("shuffle_hash"), ["who", "version"], "left")
    cut = found.select("doc_id", F.split("whole", "\n", -1).alias("parts"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    return cut.select(
        "doc_id", F.size("parts").cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_dropped"),
        F.array_join(F.transform(kept, lambda k: F.get("parts", k)), "\n").alias("kept"))
