"""Context and prompt assembly for a batch of questions (C1-C10), and the
explanation edges of each answer (Z1-Z11).

Every question's sections come from joins of the understood-questions table
with the per-value retrieval tables (:mod:`.retrieval`), so the work is a few
joins against small tables whatever the number of questions. Text is
assembled with ``collect_list(struct(pos, line))`` sorted by position; groups
hold at most k lines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.agg import round_dec
from ..functions.broadcast import checked_broadcast
from ..functions.text import py_list_repr, written
from ..operators.chunking import chunk_recursive
from ..operators.graph import Graph, writing_stage
from ..operators.inverted import InvertedIndex, index_texts, knn_inverted
from ..operators.patterns import top_k_per
from ..operators.encoders import embed
from ..operators.vectors import dedup_by_key, fit_idf, knn_dense, tfidf_rows
from ..session import scratch_path
from . import retrieval as rt
from .text import feature_docs, read_vectors, review_docs, write_vectors

# Retrieval modes.
HYBRID = "Hybrid (Graph + Embeddings)"
BASELINE = "Baseline (Graph Only)"
VECTOR = "Embeddings (Vector Only)"
GRAPH_MODES = (HYBRID, BASELINE)
VECTOR_MODES = (HYBRID, VECTOR)

# Messages and headers.
NO_CONTEXT = "No relevant data found in the selected retrieval source."
TEXT_HEADER = "Relevant Text Reviews:"
FEATURE_HEADER = "Relevant Hotel Feature Profiles:"
TEXT_K = 3
FEATURE_K = 10
# Keys of found documents that are broadcast to look up their texts.
_BROADCAST_KEYS = 500_000


def _num(c: Column) -> Column:
    """A number as the reference prints it; a missing value prints None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def _r2(c: str) -> Column:
    return _num(round_dec(F.col(c), 2))


def _lines(rows: DataFrame, seq: int, line: Column) -> DataFrame:
    return rows.select("question_id", F.lit(seq).alias("seq"), "pos", line.alias("line"))


# ----------------------------------------------------------------------------- graph sections
def graph_lines(g: Graph, u: DataFrame, idx: rt.RetrievalIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) of the graph sections of every question.

    headers: (question_id, seq, header, always) -- ``always`` marks sections
    printed even without lines; lines: (question_id, seq, pos, line)."""
    idx = idx or rt.retrieval_index(g)
    heads, lines = [], []
    # Entity columns get a q_ prefix: names are case-insensitive, and the
    # retrieval tables carry Country / Hotel columns of their own.
    u = u.select("question_id", F.col("city").alias("q_city"), F.col("country").alias("q_country"),
                 F.col("traveller_type").alias("q_type"), F.col("gender").alias("q_gender"),
                 "age_groups", "sort_by", "country_mode")

    city = u.where(F.col("q_city").isNotNull())
    r1 = idx.r1
    heads.append(city.select("question_id", F.lit(1).alias("seq"),
                             F.concat(F.lit("Top Hotels in "), F.col("q_city"), F.lit(" (from KG):")).alias("header")))
    lines.append(_lines(city.join(r1, F.lower(city["q_city"]) == r1["city_key"]), 1,
                        F.concat(F.lit("Hotel: "), F.col("Hotel"), F.lit(" (Rating: "), _num(F.col("Score")), F.lit(")"))))

    country = u.where(F.col("q_country").isNotNull())
    r2 = idx.r2
    heads.append(country.select("question_id", F.lit(2).alias("seq"),
                                F.concat(F.lit("Top Hotels in "), F.col("q_country"), F.lit(" (from KG):")).alias("header")))
    lines.append(_lines(country.join(r2, F.lower(country["q_country"]) == r2["country_key"]), 2,
                        F.concat(F.lit("Hotel: "), F.col("Hotel"), F.lit(" (Rating: "), _num(F.col("Score")), F.lit(")"))))

    typed = u.where(F.col("q_type").isNotNull())
    r4 = idx.r4
    r3 = idx.r3
    t_c = typed.where("country_mode")
    t_h = typed.where("NOT country_mode")
    heads.append(t_c.select("question_id", F.lit(3).alias("seq"),
                            F.concat(F.lit("Top Rated Countries for '"), F.col("q_type"), F.lit("':")).alias("header")))
    heads.append(t_h.select("question_id", F.lit(3).alias("seq"),
                            F.concat(F.lit("Top Hotels for '"), F.col("q_type"), F.lit("':")).alias("header")))
    lines.append(_lines(t_c.join(r4, F.lower(t_c["q_type"]) == r4["type_key"]), 3,
                        F.concat(F.lit("Country: "), F.col("Country"), F.lit(" (Avg Rating: "), _r2("avgRating"), F.lit(")"))))
    lines.append(_lines(t_h.join(r3, F.lower(t_h["q_type"]) == r3["type_key"]), 3,
                        F.concat(F.lit("Hotel: "), F.col("hotelName"), F.lit(" (Avg Rating: "), _r2("avgRating"), F.lit(")"))))

    gender = u.where(F.col("q_gender").isNotNull())
    r5 = idx.r5
    heads.append(gender.select("question_id", F.lit(4).alias("seq"),
                               F.concat(F.lit("Popular for "), F.col("q_gender"), F.lit(":")).alias("header")))
    lines.append(_lines(gender.join(r5, F.lower(gender["q_gender"]) == r5["gender_key"]), 4,
                        F.concat(F.lit("Country: "), F.col("Country"), F.lit(" ("), _num(F.col("Visits")), F.lit(" visits)"))))

    aged = u.where(F.col("age_groups").isNotNull()).withColumn("groups_key", py_list_repr("age_groups"))
    r6 = idx.r6
    r7 = idx.r7
    a_c = aged.where("country_mode")
    a_h = aged.where("NOT country_mode")
    heads.append(a_c.select("question_id", F.lit(5).alias("seq"),
                            F.concat(F.lit("Popular Countries for Ages "), F.col("groups_key"), F.lit(":")).alias("header")))
    heads.append(a_h.select("question_id", F.lit(5).alias("seq"),
                            F.concat(F.lit("Top Rated Hotels for Ages "), F.col("groups_key"), F.lit(":")).alias("header")))
    lines.append(_lines(a_c.join(r6, "groups_key"), 5,
                        F.concat(F.lit("Country: "), F.col("Country"), F.lit(" ("), _num(F.col("Visits")), F.lit(" visits)"))))
    lines.append(_lines(a_h.join(r7, "groups_key"), 5,
                        F.concat(F.lit("Hotel: "), F.col("Hotel"), F.lit(" (Avg Rating: "), _r2("avgRating"), F.lit(")"))))

    # Sort section: always printed; a message line when nothing was found.
    sorted_q = u.where(F.col("sort_by").isNotNull()).select(
        "question_id", "sort_by", "q_city", "q_country",
        F.when(F.col("q_city").isNotNull(), "city").when(F.col("q_country").isNotNull(), "country")
        .otherwise("global").alias("scope"),
        F.coalesce(F.lower("q_city"), F.lower("q_country"), F.lit("")).alias("scope_key"),
        F.coalesce("q_city", "q_country", F.lit("Global")).alias("location_str"),
    )
    display_of = F.create_map(*[x for dim, v in rt.DIMENSIONS.items() for x in (F.lit(dim), F.lit(v[2]))])
    best = idx.best.select("sort_by", "scope", "scope_key", "pos", F.concat(
        F.lit("Hotel: "), F.col("Hotel"), F.lit(" ("), display_of[F.col("sort_by")], F.lit(": "), _r2("AvgScore"), F.lit(")")
    ).alias("line"))
    label_of = F.create_map(*[x for dim, v in rt.DIMENSIONS.items() for x in (F.lit(dim), F.lit(v[1]))])
    heads.append(sorted_q.select("question_id", F.lit(6).alias("seq"), F.concat(
        label_of[F.col("sort_by")], F.lit(" Hotels ("), F.col("location_str"), F.lit("):")).alias("header")))
    found = sorted_q.join(best, ["sort_by", "scope", "scope_key"]).select("question_id", F.lit(6).alias("seq"), "pos", "line")
    scope_msg = F.when(F.col("q_city").isNotNull(), F.concat(F.lit("in "), F.col("q_city"))).when(
        F.col("q_country").isNotNull(), F.concat(F.lit("in "), F.col("q_country"))).otherwise(F.lit("Globally"))
    msg_of = F.create_map(*[x for dim, v in rt.DIMENSIONS.items() for x in (F.lit(dim), F.lit(v[3]))])
    missing = sorted_q.join(found.select("question_id").distinct(), "question_id", "left_anti").select(
        "question_id", F.lit(6).alias("seq"), F.lit(1).alias("pos"),
        F.replace(msg_of[F.col("sort_by")], F.lit("{scope}"), scope_msg).alias("line"))
    lines += [found, missing]

    headers = _union(heads).withColumn("always", F.col("seq") == 6)
    return headers, _union(lines)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ----------------------------------------------------------------------------- vector sections
@dataclass
class TextIndex:
    """Documents are known by a key made of the review, the chunk and the text,
    so ties between equal scores do not depend on the files' layout."""

    text_idf: DataFrame       # token, df, idf
    text_vectors: InvertedIndex
    text_docs: DataFrame      # id, review_id, hotel_id, chunk_no, text
    feature_idf: DataFrame
    feature_vectors: InvertedIndex
    feature_docs: DataFrame   # id, review_id, hotel_id, chunk_no, text


def _document_key() -> Column:
    return F.concat_ws("#", F.coalesce("review_id", F.lit("")), F.lpad(F.col("chunk_no").cast("string"), 10, "0"), F.sha2("text", 256))


def _chunks(docs: DataFrame) -> DataFrame:
    return chunk_recursive(docs, id_col="review_id", keep=["hotel_id"]).withColumnRenamed("doc_id", "review_id").withColumn("id", _document_key())


class TextIndexOnUse(TextIndex):
    """An index whose texts and features are each built when first read: a
    search of the texts does not wait for the features."""

    def __init__(self, halves: dict[str, Callable[[], tuple[DataFrame, InvertedIndex, DataFrame]]]):
        self._halves, self._lock = halves, RLock()

    def __getattr__(self, name: str):
        half = name.partition("_")[0]
        if name not in {f.name for f in fields(TextIndex)} or half not in self.__dict__.get("_halves", {}):
            raise AttributeError(name)
        with self._lock:
            if name not in self.__dict__:
                self.__dict__.update(zip((f"{half}_idf", f"{half}_vectors", f"{half}_docs"), self._halves[half]()))
        return self.__dict__[name]


def build_text_index(spark: SparkSession, reviews: DataFrame, hotels: DataFrame) -> TextIndex:
    """Chunk and encode review documents and feature documents once, each when
    first read, written to the shared checkpoint folder. Keys are made again
    when documents are read: their digests are longer than most texts."""
    stage = writing_stage(spark, scratch_path(spark, "text_index"))

    def half(name: str, make: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, InvertedIndex, DataFrame]:
        docs = stage({f"{name}_docs": _chunks(make(reviews, hotels)).drop("id")})[f"{name}_docs"].withColumn("id", _document_key())
        idf = stage({f"{name}_idf": fit_idf(docs, "id", "text")})[f"{name}_idf"]
        return idf, index_texts(docs.select("id", "text"), idf), docs

    return TextIndexOnUse({"text": lambda: half("text", review_docs), "feature": lambda: half("feature", feature_docs)})


def _encode_questions(questions: DataFrame, idf: DataFrame) -> DataFrame:
    """Every question gets a vector; one sharing no token with the corpus is
    all zeros, so its neighbours are the k smallest ids (a retriever always
    returns k documents)."""
    enc = tfidf_rows(questions, "question_id", "user_query", idf)
    return questions.select(F.col("question_id").alias("id")).join(enc, "id", "left").select(
        "id",
        F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"),
        F.coalesce("weights", F.array().cast("array<double>")).alias("weights"),
    )


def _distinct_texts(questions: DataFrame) -> DataFrame:
    """(question_id, user_query) of one representative per distinct text, written
    so the ids are stable: neighbours depend only on the text."""
    texts = questions.select(F.coalesce("user_query", F.lit("")).alias("user_query")).distinct()
    return written(texts.withColumn("question_id", F.monotonically_increasing_id()), "question_texts")


def _per_question(questions: DataFrame, texts: DataFrame, per_text: DataFrame) -> DataFrame:
    """Spread per-text rows (question_id = text id) back to every question."""
    ids = texts.select(F.col("question_id").alias("_tid"), "user_query")
    back = per_text.withColumnRenamed("question_id", "_tid").join(ids, "_tid")
    q = questions.select("question_id", F.coalesce("user_query", F.lit("")).alias("user_query"))
    return q.join(back, "user_query").drop("user_query", "_tid")


def _with_text(nn: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, pos, text) of (query_id, pos, neighbor_id); repeats of a
    document's key hold the same text."""
    by_key = docs.groupBy(F.col("id").alias("neighbor_id")).agg(F.any_value("text").alias("text"))
    return nn.join(by_key, "neighbor_id").select(F.col("query_id").alias("question_id"), "pos", "text")


def _encodings(texts: DataFrame, idf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct encodings as (id, tokens, weights), and (question, query_id):
    which of them each text has. Neighbours depend only on the encoded text
    (words that no document has drop out), so each one is searched once."""
    pairs = F.array_sort(F.arrays_zip(F.col("tokens"), F.transform("weights", lambda w: F.round(w, 12)).alias("weights")))
    enc = written(_encode_questions(texts, idf).select("id", pairs.alias("encoding")), "question_encodings")
    one = written(enc.groupBy("encoding").agg(F.min("id").alias("one")), "distinct_encodings")
    of = enc.join(one, "encoding").select(F.col("id").alias("question"), F.col("one").alias("query_id"))
    return one.select(F.col("one").alias("id"), F.col("encoding.tokens").alias("tokens"), F.col("encoding.weights").alias("weights")), of


def _found_docs(nn: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, hotel_id, text) of the documents that are anyone's neighbours, written."""
    near = checked_broadcast(written(nn.select(F.col("neighbor_id").alias("id")).distinct(), "neighbour_ids"), _BROADCAST_KEYS)
    return written(docs.select("id", "hotel_id", "text").join(near, "id", "left_semi"), "neighbour_docs")


def _spread(of: DataFrame, per_encoding: DataFrame) -> DataFrame:
    """Lines per encoding (question_id) brought to the texts that have it."""
    lines = per_encoding.withColumnRenamed("question_id", "query_id")
    return of.join(lines, "query_id").select(F.col("question").alias("question_id"), "pos", "text")


def text_neighbours(index: TextIndex, questions: DataFrame, k: int = TEXT_K, texts: DataFrame | None = None) -> DataFrame:
    """(question_id, pos, text): the k most similar review chunks."""
    texts = _distinct_texts(questions) if texts is None else texts
    asked, of = _encodings(texts, index.text_idf)
    nn = written(knn_inverted(asked, index.text_vectors, k), "text_neighbours")
    return _per_question(questions, texts, _spread(of, _with_text(nn, _found_docs(nn, index.text_docs))))


def feature_neighbours(index: TextIndex, questions: DataFrame, k: int = FEATURE_K,
                       texts: DataFrame | None = None) -> DataFrame:
    """(question_id, pos, text): the k most similar feature documents, then the
    best one per hotel id (documents without an id are all kept)."""
    texts = _distinct_texts(questions) if texts is None else texts
    asked, of = _encodings(texts, index.feature_idf)
    nn = written(knn_inverted(asked, index.feature_vectors, k), "feature_neighbours")
    docs = _found_docs(nn, index.feature_docs)
    keys = docs.select(F.col("id").alias("neighbor_id"), F.col("hotel_id").cast("string").alias("key")).distinct()
    return _per_question(questions, texts, _spread(of, _with_text(dedup_by_key(nn, keys), docs)))


def write_document_vectors(index: TextIndex, path: str, model: str, features: bool = True) -> None:
    """Encode the index's documents with a registered model and put the vectors
    into the store under the model's short name (other models stay)."""
    docs = index.feature_docs if features else index.text_docs
    one = docs.groupBy(F.col("id").alias("doc_id")).agg(F.any_value("hotel_id").alias("hotel_id"), F.any_value("text").alias("text"))
    write_vectors(embed(one, "text", model, ["doc_id", "hotel_id"]), path, model.split(" ")[0])


def store_neighbours(store: str, questions: DataFrame, model: str, k: int = FEATURE_K, per_hotel: bool = True) -> DataFrame:
    """(question_id, pos, text): the k stored documents nearest to each question
    by cosine, both encoded by ``model``; then the best one per hotel. Raises
    if the store has no such model."""
    spark = questions.sparkSession
    docs = read_vectors(spark, store, model)
    if docs is None:
        raise KeyError(f"no vectors of {model} in {store}")
    texts = _distinct_texts(questions)
    near = embed(texts, "user_query", model, ["question_id"]).select(F.col("question_id").alias("id"), F.col("embedding").alias("vec"))
    nn = written(knn_dense(near, docs.select(F.col("doc_id").alias("id"), F.col("embedding").alias("vec")), k, "cosine"), "store_neighbours")
    if per_hotel:
        keys = docs.select(F.col("doc_id").alias("neighbor_id"), F.col("hotel_id").cast("string").alias("key"))
        nn = dedup_by_key(nn, keys)
    near = nn.select(F.col("neighbor_id").alias("id")).distinct()
    return _per_question(questions, texts, _with_text(nn, docs.select(F.col("doc_id").alias("id"), "text").join(near, "id", "left_semi")))


def vector_lines(index: TextIndex, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    heads = questions.select("question_id", F.lit(7).alias("seq"), F.lit(TEXT_HEADER).alias("header"), F.lit(True).alias("always"))
    heads = heads.unionByName(
        questions.select("question_id", F.lit(8).alias("seq"), F.lit(FEATURE_HEADER).alias("header"), F.lit(True).alias("always")))
    texts = _distinct_texts(questions)  # written once, shared by both searches
    lines = text_neighbours(index, questions, texts=texts).select(
        "question_id", F.lit(7).alias("seq"), "pos", F.col("text").alias("line"))
    lines = lines.unionByName(
        feature_neighbours(index, questions, texts=texts).select("question_id", F.lit(8).alias("seq"), "pos", F.col("text").alias("line")))
    return heads, lines


def lines(g: Graph, u: DataFrame, questions: DataFrame, idx: rt.RetrievalIndex | None, text_index: TextIndex | None,
          mode: str) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) of the sections that a retrieval mode has."""
    parts = []
    if mode in GRAPH_MODES:
        parts.append(graph_lines(g, u, idx))
    if mode in VECTOR_MODES:
        if text_index is None:
            raise ValueError(f"mode {mode} needs a text index")
        parts.append(vector_lines(text_index, questions))
    if not parts:
        raise ValueError(f"unknown mode {mode}")
    return _union([h for h, _ in parts]), _union([l_ for _, l_ in parts])


# ----------------------------------------------------------------------------- assembly
def sections(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """(question_id, seq, section): header + newline-joined lines in position
    order; sections without lines only when marked ``always``."""
    body = lines.groupBy("question_id", "seq").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("pos", "line"))).getField("line"), "\n").alias("body"))
    return (
        headers.join(body, ["question_id", "seq"], "left")
        .where(F.col("body").isNotNull() | F.col("always"))
        .select("question_id", "seq", F.concat(F.col("header"), F.lit("\n"), F.coalesce("body", F.lit(""))).alias("section"))
    )


def full_context(questions: DataFrame, secs: DataFrame) -> DataFrame:
    """(question_id, context): sections joined by a blank line, or the fallback."""
    ctx = secs.groupBy("question_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("seq", "section"))).getField("section"), "\n\n").alias("context"))
    return questions.select("question_id").join(ctx, "question_id", "left").select(
        "question_id", F.coalesce(F.when(F.col("context") != "", F.col("context")), F.lit(NO_CONTEXT)).alias("context"))


def entity_summary(u: DataFrame) -> Column:
    """``k: v`` pairs joined by ', ' in detection order; None when empty."""
    pairs = [
        ("City", F.col("city")), ("Country", F.col("country")), ("Hotel", F.col("hotel")),
        ("Traveller Type", F.col("traveller_type")), ("Gender", F.col("gender")),
        ("Target Age Groups", F.when(F.col("age_groups").isNotNull(), py_list_repr("age_groups"))),
        ("Sort By", F.col("sort_by")),
    ]
    s = F.concat_ws(", ", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in pairs])
    return F.when(s == "", F.lit("None")).otherwise(s)


def prompts(u: DataFrame, ctx: DataFrame, mode: str = HYBRID) -> DataFrame:
    """(question_id, prompt)."""
    ind = "    "
    return u.join(ctx, "question_id").select(
        "question_id",
        F.concat(
            F.lit(f"\n{ind}You are a Hotel Recommender.\n{ind}RETRIEVAL MODE: {mode}\n{ind}DETECTED ENTITIES: "),
            entity_summary(u), F.lit(f"\n{ind}CONTEXT:\n{ind}"), F.col("context"),
            F.lit(f"\n{ind}USER QUESTION: "), F.coalesce(F.col("user_query"), F.lit("")), F.lit(f"\n{ind}Answer:\n{ind}"),
        ).alias("prompt"),
    )


def query_log(u: DataFrame, mode: str = HYBRID) -> DataFrame:
    """(question_id, seq, intent, query_name): one entry per graph section run,
    whether or not it found anything."""
    if mode not in GRAPH_MODES:
        return u.sparkSession.createDataFrame([], "question_id bigint, seq int, intent string, query_name string")
    cm = F.col("country_mode")
    groups = py_list_repr("age_groups")
    loc = F.coalesce("city", "country", F.lit("Global"))
    label_of = F.create_map(*[x for dim, v in rt.DIMENSIONS.items() for x in (F.lit(dim), F.lit(v[1]))])
    entries = [
        (1, F.col("city"), F.concat(F.lit("City Search ("), F.col("city"), F.lit(")")), F.lit("hotels_by_city")),
        (2, F.col("country"), F.concat(F.lit("Country Search ("), F.col("country"), F.lit(")")), F.lit("hotels_by_country")),
        (3, F.col("traveller_type"),
         F.when(cm, F.concat(F.lit("Country by Traveller Type ("), F.col("traveller_type"), F.lit(")")))
         .otherwise(F.concat(F.lit("Hotel by Traveller Type ("), F.col("traveller_type"), F.lit(")"))),
         F.when(cm, F.lit("best_countries_by_traveller_type")).otherwise(F.lit("hotels_by_traveller_type"))),
        (4, F.col("gender"), F.concat(F.lit("Gender Demographics ("), F.col("gender"), F.lit(")")), F.lit("top_countries_by_gender")),
        (5, F.col("age_groups"),
         F.when(cm, F.concat(F.lit("Country by Age Group ("), groups, F.lit(")")))
         .otherwise(F.concat(F.lit("Hotel by Age Group ("), groups, F.lit(")"))),
         F.when(cm, F.lit("top_countries_by_age_groups")).otherwise(F.lit("top_hotels_by_age_groups"))),
        (6, F.col("sort_by"), F.concat(F.lit("Sort by "), label_of[F.col("sort_by")], F.lit(" ("), loc, F.lit(")")),
         F.concat(F.lit("best_hotels_by_"), F.lower("sort_by"))),
    ]
    return _union([
        u.where(cond.isNotNull()).select("question_id", F.lit(seq).alias("seq"), intent.alias("intent"), name.alias("query_name"))
        for seq, cond, intent, name in entries
    ])


# ----------------------------------------------------------------------------- explanation edges
EDGE_K = 5


def _edges(rows: DataFrame, key: str, source: Column, rel: Column, target: Column, k: int = EDGE_K) -> DataFrame:
    """At most k distinct (source, rel, target) edges per key, in (source, target) order."""
    e = rows.select(key, source.alias("source"), rel.alias("rel"), target.alias("target")).distinct()
    return top_k_per(e, [key], [F.asc_nulls_last("source"), F.asc_nulls_last("target"), F.asc("rel")], k, "pos")


def explain_city(g: Graph) -> DataFrame:
    """Z1/Z9: hotel LOCATED_IN city, per lower-cased city."""
    rows = g.hotel_in_city.join(g.hotel.select("hotel_id", "name"), "hotel_id").withColumn("city_key", F.lower("city"))
    return _edges(rows, "city_key", F.col("name"), F.lit("LOCATED_IN"), F.col("city"))


def explain_country(g: Graph) -> DataFrame:
    """Z2: hotel LOCATED_IN country, per lower-cased country."""
    rows = g.hotel_place.join(g.hotel.select("hotel_id", "name"), "hotel_id").withColumn("country_key", F.lower("country"))
    return _edges(rows, "country_key", F.col("name"), F.lit("LOCATED_IN"), F.col("country"))


def explain_type(g: Graph) -> DataFrame:
    """Z3: '<type> Traveller' LIKES hotel, per lower-cased type."""
    rows = g.segment_stats.where(F.col("type").isNotNull()).join(g.hotel.select("hotel_id", "name"), "hotel_id") \
        .withColumn("type_key", F.lower("type"))
    return _edges(rows, "type_key", F.concat(F.col("type"), F.lit(" Traveller")), F.lit("LIKES"), F.col("name"))


def explain_gender(g: Graph) -> DataFrame:
    """Z4: '<gender> Traveller' VISITED country, per lower-cased gender."""
    rows = g.segment_stats.where(F.col("gender").isNotNull()).join(g.hotel_place, "hotel_id") \
        .withColumn("gender_key", F.lower("gender"))
    return _edges(rows, "gender_key", F.concat(F.col("gender"), F.lit(" Traveller")), F.lit("VISITED"), F.col("country"))


def explain_age(g: Graph) -> DataFrame:
    """Z5: 'Age Group <g>' RATED_HIGHLY hotel, per exact age label."""
    rows = g.segment_stats.where(F.col("age").isNotNull()).join(g.hotel.select("hotel_id", "name"), "hotel_id")
    return _edges(rows, "age", F.concat(F.lit("Age Group "), F.col("age")), F.lit("RATED_HIGHLY"), F.col("name"))


def explain_city_top(g: Graph) -> DataFrame:
    """Z6: city CONTAINS_TOP_HOTEL hotel."""
    rows = g.hotel_in_city.join(g.hotel.select("hotel_id", "name"), "hotel_id").withColumn("city_key", F.lower("city"))
    return _edges(rows, "city_key", F.col("city"), F.lit("CONTAINS_TOP_HOTEL"), F.col("name"))


def explain_country_top(g: Graph, rel: str = "CONTAINS_TOP_HOTEL") -> DataFrame:
    """Z7 (and Z10 with rel LOCATED_IN): country -> hotel."""
    rows = g.hotel_place.join(g.hotel.select("hotel_id", "name"), "hotel_id").withColumn("country_key", F.lower("country"))
    return _edges(rows, "country_key", F.col("country"), F.lit(rel), F.col("name"))


def explain_global_sort(g: Graph, idx: rt.RetrievalIndex | None = None) -> DataFrame:
    """Z8: 'Global Top' BEST_<DIM> hotel, the 5 best hotels by the mean review
    score of each sort dimension (the intent of the global sort edges)."""
    if idx is not None:
        return idx.best.where((F.col("scope") == "global") & (F.col("pos") <= EDGE_K)).select(
            "sort_by", "pos", F.lit("Global Top").alias("source"),
            F.concat(F.lit("BEST_"), F.upper("sort_by")).alias("rel"), F.col("Hotel").alias("target"))
    parts = [
        rt.best_hotels_all(g, dim, "global", EDGE_K).select(
            F.lit(dim).alias("sort_by"), "pos", F.lit("Global Top").alias("source"),
            F.lit(f"BEST_{dim.upper()}").alias("rel"), F.col("Hotel").alias("target"))
        for dim in rt.DIMENSIONS
    ]
    return _union(parts)


EDGE_TABLES = {"city": explain_city, "country": explain_country, "type": explain_type, "gender": explain_gender, "age": explain_age}


def with_edges(g: Graph, idx: rt.RetrievalIndex, stage=None) -> rt.RetrievalIndex:
    """The index with the explanation edges of every parameter value, written
    by ``stage`` like its other tables."""
    tables = {f"edge_{name}": make(g) for name, make in EDGE_TABLES.items()}
    tables = stage(tables) if stage else tables
    return replace(idx, edges={name: tables[f"edge_{name}"] for name in EDGE_TABLES})


def explain_edges(g: Graph, u: DataFrame, mode: str = HYBRID, idx: rt.RetrievalIndex | None = None) -> DataFrame:
    """(question_id, seq, source, rel, target): the edges shown for each answer,
    in section order, first edge per (source, target) kept."""
    if mode not in GRAPH_MODES:
        return u.sparkSession.createDataFrame([], "question_id bigint, seq int, source string, rel string, target string")
    idx = idx or rt.retrieval_index(g)
    e = (idx if idx.edges else with_edges(g, idx)).edges
    r1k = idx.r1.select("city_key").distinct()
    r2k = idx.r2.select("country_key").distinct()
    r3k = idx.r3.select("type_key").distinct()
    r5k = idx.r5.select("gender_key").distinct()
    r7k = idx.r7.select("groups_key").distinct()

    def pick(q: DataFrame, edges: DataFrame, left: Column, key: str, section: int) -> DataFrame:
        j = q.join(edges, left == edges[key])
        return j.select("question_id", F.lit(section).alias("section"), "pos", "source", "rel", "target")

    parts = []
    c = u.where(F.col("city").isNotNull()).join(r1k, F.lower(F.col("city")) == F.col("city_key"), "left_semi")
    parts.append(pick(c, e["city"], F.lower(c["city"]), "city_key", 1))
    n = u.where(F.col("country").isNotNull()).join(r2k, F.lower(F.col("country")) == F.col("country_key"), "left_semi")
    parts.append(pick(n, e["country"], F.lower(n["country"]), "country_key", 2))
    t = u.where(F.col("traveller_type").isNotNull() & ~F.col("country_mode")).join(
        r3k, F.lower(F.col("traveller_type")) == F.col("type_key"), "left_semi")
    parts.append(pick(t, e["type"], F.lower(t["traveller_type"]), "type_key", 3))
    s = u.where(F.col("gender").isNotNull()).join(r5k, F.lower(F.col("gender")) == F.col("gender_key"), "left_semi")
    parts.append(pick(s, e["gender"], F.lower(s["gender"]), "gender_key", 4))
    a = (u.where(F.col("age_groups").isNotNull() & ~F.col("country_mode"))
         .withColumn("groups_key", py_list_repr("age_groups")).join(r7k, "groups_key", "left_semi")
         .withColumn("first_group", F.col("age_groups")[0]))
    parts.append(pick(a, e["age"], a["first_group"], "age", 5))
    earlier = written(_union(parts), "section_edges")  # read by each fallback and by the result

    # Sort fallback: only for questions that have no edge yet.
    srt = u.where(F.col("sort_by").isNotNull()).join(earlier.select("question_id").distinct(), "question_id", "left_anti")
    sc = srt.where(F.col("city").isNotNull())
    sn = srt.where(F.col("city").isNull() & F.col("country").isNotNull())
    sg = srt.where(F.col("city").isNull() & F.col("country").isNull())
    fallback = [
        pick(sc, e["city"], F.lower(sc["city"]), "city_key", 6),
        pick(sn, e["country"], F.lower(sn["country"]), "country_key", 6),
        sg.join(explain_global_sort(g, idx), "sort_by").select("question_id", F.lit(6).alias("section"), "pos", "source", "rel", "target"),
    ]
    alle = _union([earlier] + fallback)
    first = top_k_per(alle, ["question_id", "source", "target"], [F.asc("section"), F.asc("pos")], 1, "_r")
    # At most 6 sections x 5 edges per question.
    w = Window.partitionBy("question_id").orderBy("section", "pos")
    return first.withColumn("seq", F.row_number().over(w)).select("question_id", "seq", "source", "rel", "target")
