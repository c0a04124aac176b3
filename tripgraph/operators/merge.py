"""Merging further source rows into a written graph.

A store holds every graph table dealt to hash buckets of a key, one parquet
partition per bucket. ``merge_batch`` reads the buckets that a batch touches,
works out their new rows and writes those buckets anew; the others are neither
read nor rewritten. What the graph itself does not say is kept beside it:

* ``review_rows``: the last row of each (review, traveller, hotel) that is part
  of the graph, with its place in the order of all batches. A review's vertex
  is the last of its rows.
* ``pending``: the same for rows whose traveller or hotel does not exist yet. A
  later batch may bring it.
* ``hotel_raw``: (sum, count) of the overall score per hotel id over all rows.

The derived tables are maintained by difference: the contributions of the
touched reviews (rows of the batch, rows set free, reviews by travellers whose
segment changed) before the merge are taken away from the exact states, and
those after it are added. Sums are decimals, so nothing drifts.

A store may keep some tables only, with those that they are maintained from
(``NEEDS``); review rows then carry only the columns that those tables read.

Building a and then merging b gives the tables of building a and b at once,
with all of b's rows after a's. All new buckets are written to scratch tables
before the first one is put in place; putting them there can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.agg import sum_count
from ..functions.broadcast import checked_broadcast
from ..functions.text import written
from ..session import scratch_path
from ..sources.readers import path_exists
from ..sources.schemas import SCORE_COLUMNS
from .graph import _BROADCAST_IDS, VISA_REQUIRED_VALUES, Graph, _prepare, distinct_pairs, last_wins, score_states

BUCKETS = 64
# The column whose hash deals a table to buckets, and the columns that tell its rows apart.
TABLES = {
    "country": ("name", ["name"]), "city": ("name", ["name"]), "hotel": ("hotel_id", ["hotel_id"]),
    "traveller": ("user_id", ["user_id"]), "review": ("review_id", ["review_id"]),
    "city_in_country": ("city", ["city", "country"]), "hotel_in_city": ("hotel_id", ["hotel_id", "city"]),
    "from_country": ("user_id", ["user_id", "country"]), "wrote": ("user_id", ["user_id", "review_id"]),
    "reviewed": ("review_id", ["review_id", "hotel_id"]), "stayed_at": ("user_id", ["user_id", "hotel_id"]),
    "needs_visa": ("from_country", ["from_country", "to_country"]), "hotel_place": ("hotel_id", ["hotel_id", "city", "country"]),
    "hotel_stats": ("hotel_id", ["hotel_id"]), "segment_stats": ("hotel_id", ["hotel_id", "age", "type", "gender"]),
    "review_rows": ("review_id", ["review_id", "user_id", "hotel_id"]), "pending": ("review_id", ["review_id", "user_id", "hotel_id"]),
    "hotel_raw": ("hotel_id", ["hotel_id"]),
}
# What a table is maintained from, beside the batch.
_LIVE = ["traveller", "hotel", "pending"]
NEEDS = {
    "hotel": ["hotel_raw"], "hotel_place": ["hotel_in_city", "city_in_country"], "review": ["review_rows"], "review_rows": _LIVE,
    "wrote": _LIVE, "reviewed": _LIVE, "stayed_at": _LIVE, "hotel_stats": ["review_rows"], "segment_stats": ["review_rows", "wrote"],
}
_BASE = ["name", "star_rating", "cleanliness_base", "comfort_base", "facilities_base"]
_SEGMENT = ["age", "type", "gender"]
_STATES = [f"{s}_{p}" for s in SCORE_COLUMNS for p in ("sum", "n")]


@dataclass(frozen=True)
class GraphStore:
    """A graph in buckets under ``path``; ``buckets`` and ``tables`` (the graph's
    tables that are kept; None: all) must stay what they were."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    tables: tuple[str, ...] | None = None

    def kept(self) -> set[str]:
        """The tables that a merge maintains: those asked for and what they need."""
        found, todo = set(), list(TABLES if self.tables is None else self.tables)
        while todo:
            name = todo.pop()
            if name not in found:
                found.add(name)
                todo += NEEDS.get(name, [])
        return found

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(TABLES[name][0]).cast("string")), F.lit(self.buckets)).cast("int")

    def table(self, name: str) -> DataFrame | None:
        place = f"{self.path}/{name}"
        return self.spark.read.parquet(place) if path_exists(self.spark, place) else None

    def part(self, name: str, like: DataFrame, rows: DataFrame) -> DataFrame:
        """The rows of a table in the buckets that hold keys of ``rows``; with
        the columns of ``like`` and no rows if there is no table yet."""
        table = self.table(name)
        if table is None:
            return like.limit(0)
        touched = [r[0] for r in rows.select(self.bucket(name).alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        return table.where(F.col("bucket").isin(touched)).drop("bucket").select(like.columns)

    def graph(self, schemas: dict[str, DataFrame] | None = None) -> Graph:
        """The graph as stored; ``schemas`` stand in for tables that have no row
        yet. Tables that the store does not keep are None."""
        kept = self.kept()
        found = {f.name: self.table(f.name) for f in fields(Graph) if f.name in kept}
        tables = {n: t.drop("bucket") if t is not None else schemas[n].limit(0) for n, t in found.items()}
        if "segment_stats" in tables:
            # Segments that lost their last path are kept with 0, so that their bucket is rewritten.
            tables["segment_stats"] = tables["segment_stats"].where("paths > 0")
        return Graph(**{f.name: tables.get(f.name) for f in fields(Graph)})

    def replace(self, staged: dict[str, DataFrame]) -> None:
        """Put new buckets in place of the old ones with their numbers. No merge
        takes the last row out of a bucket, so every touched one is among them.
        A large bucket is dealt to several tasks, each of which writes a file."""

        def write(item: tuple[str, DataFrame]) -> None:
            name, rows = item
            if rows.limit(1).count():
                (rows.withColumn("bucket", self.bucket(name)).hint("rebalance", "bucket").write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}"))

        with ThreadPoolExecutor(max_workers=8) as pool:
            list(pool.map(write, staged.items()))


def _add(store: GraphStore, name: str, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that were not there, rows of the touched buckets with them): for edges and bare names."""
    old = store.part(name, new, new)
    fresh = new.join(old, TABLES[name][1], "left_anti")
    return fresh, old.unionByName(fresh)


def _last(rows: DataFrame, keys: list[str], props: list[str]) -> DataFrame:
    """The last row of each key by (batch, order)."""
    order = F.struct("_batch", "_ord")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*props, "_batch", "_ord"), order).alias("v")).select(*keys, "v.*")


def _upsert(store: GraphStore, name: str, new: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """The touched buckets with ``new`` rows in place of those with their keys
    (which ``named``, a written table, holds as well). Few keys are broadcast,
    so that the rows of the buckets are not dealt again."""
    if store.table(name) is None:
        return new
    named = (new if named is None else named).select(TABLES[name][1])
    old = store.part(name, new, named)
    return old.join(checked_broadcast(named, _BROADCAST_IDS), TABLES[name][1], "left_anti").unionByName(new)


def _contributions(rows: DataFrame, traveller: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States that the reviews of ``rows`` (all their rows) add to hotel_stats and segment_stats."""
    scores = _last(rows, ["review_id"], list(SCORE_COLUMNS)).select("review_id", *SCORE_COLUMNS)
    per_hotel = scores.join(rows.select("review_id", "hotel_id").distinct(), "review_id")
    writers = rows.select("review_id", "user_id").distinct().join(traveller.select("user_id", *_SEGMENT), "user_id")
    base3 = F.col("score_cleanliness") + F.col("score_comfort") + F.col("score_facilities")
    fact = per_hotel.join(writers, "review_id").withColumn("base3", base3)
    return (per_hotel.groupBy("hotel_id").agg(*score_states()),
            fact.groupBy("hotel_id", *_SEGMENT).agg(F.count(F.lit(1)).alias("paths"), *score_states(), *sum_count("base3", "base3")))


def _shifted(store: GraphStore, name: str, before: DataFrame, after: DataFrame, states: list[str]) -> DataFrame:
    """The touched buckets of a state table with ``before`` taken away and ``after`` added."""
    keys = TABLES[name][1]
    less = before.select(*keys, *[(-F.col(c)).alias(c) for c in states])
    old = store.part(name, after.select(*keys, *states), after.select(keys).unionByName(before.select(keys)))
    total = old.unionByName(less).unionByName(after.select(*keys, *states)).groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in states])
    kinds = dict(after.dtypes)
    # The sum of no values is missing, not nought.
    out = [F.when(F.col(c[:-3] + "n") > 0, F.col(c)).cast(kinds[c]).alias(c) if c.endswith("_sum") else F.col(c).cast(kinds[c]).alias(c) for c in states]
    return total.select(*keys, *out)


def merge_batch(store: GraphStore, hotels: DataFrame, users: DataFrame, reviews: DataFrame, visa: DataFrame, batch: int) -> Graph:
    """Merge source rows into the store (an empty one: build it) and return its
    graph. ``batch`` must be greater than that of every merge before: rows of a
    later batch come after all rows of earlier ones. Rows with null keys are
    left out as in a build; an empty batch changes nothing."""
    with ThreadPoolExecutor(max_workers=8) as pool:
        return _merge(store, pool, hotels, users, reviews, visa, batch)


def _merge(store: GraphStore, pool: ThreadPoolExecutor, hotels: DataFrame, users: DataFrame, reviews: DataFrame, visa: DataFrame, batch: int) -> Graph:
    hotels, users, reviews, visa = (_prepare(d) for d in (hotels, users, reviews, visa))
    hotels = hotels.withColumnRenamed("hotel_name", "name")
    users = users.withColumnsRenamed({"traveller_type": "type", "user_gender": "gender", "age_group": "age"})
    visa_yes = visa.where(F.col("requires_visa").isin(VISA_REQUIRED_VALUES))
    staged: dict[str, Future] = {}
    kept = store.kept()
    props = ["text", "date"] * ("review" in kept) + list(SCORE_COLUMNS) * ("review_rows" in kept)

    def keep(name: str, make: Callable[[], DataFrame]) -> Future:
        return pool.submit(lambda: written(make(), name))

    def put(name: str, make: Callable[[], DataFrame]) -> None:
        if name in kept:
            staged[name] = keep(f"merge_{name}", make)

    # What the batch itself says, and the review rows that waited.
    keys = TABLES["pending"][1]
    rows = reviews.withColumnsRenamed({"review_date": "date", "review_text": "text"}).withColumn("_batch", F.lit(batch))
    rows = rows.where("review_id IS NOT NULL AND user_id IS NOT NULL AND hotel_id IS NOT NULL").select(*keys, *props, "_batch", F.col("_ord").cast("bigint").alias("_ord"))
    waiting = store.table("pending")
    waited = rows.limit(0) if waiting is None else waiting.drop("bucket").select(rows.columns)
    makers = {
        "traveller": lambda: last_wins(users, "user_id", _SEGMENT),
        "hotel": lambda: last_wins(hotels, "hotel_id", _BASE),
        "hotel_raw": lambda: reviews.where("hotel_id IS NOT NULL").groupBy("hotel_id").agg(*sum_count("score_overall", "score_overall")),
        "city_in_country": lambda: distinct_pairs(hotels, "city", "country"),
        "hotel_in_city": lambda: distinct_pairs(hotels, "hotel_id", "city"),
        "pending": lambda: _last(rows.unionByName(waited), keys, props),
    }
    made = {name: keep(f"batch_{name}", make) for name, make in makers.items() if name in kept}
    people, base, raw_new, batch_cc, batch_hc, asked = (made[name].result() if name in made else None for name in makers)

    # Travellers, places, visa rules.
    names = [d.select(F.col(c).alias("name")) for d, c in ((hotels, "country"), (users, "country"), (visa_yes, "from_country"), (visa_yes, "to_country"))]
    for n in names[1:]:
        names[0] = names[0].unionByName(n)
    put("traveller", lambda: _upsert(store, "traveller", people))
    put("from_country", lambda: _add(store, "from_country", distinct_pairs(users, "user_id", "country"))[1])
    put("needs_visa", lambda: _upsert(store, "needs_visa", last_wins(visa_yes, ["from_country", "to_country"], ["visa_type"])))
    put("country", lambda: _add(store, "country", names[0].where("name IS NOT NULL").distinct())[1])
    put("city", lambda: _add(store, "city", hotels.where("city IS NOT NULL").select(F.col("city").alias("name")).distinct())[1])
    put("city_in_country", lambda: _add(store, "city_in_country", batch_cc)[1])
    put("hotel_in_city", lambda: _add(store, "hotel_in_city", batch_hc)[1])

    def new_paths() -> DataFrame:
        """Over a new first edge (its city may have old countries), or over a new second one."""
        new_cc, new_hc = _add(store, "city_in_country", batch_cc)[0], _add(store, "hotel_in_city", batch_hc)[0]
        old_cc, old_hc = store.table("city_in_country"), store.table("hotel_in_city")
        every_cc = new_cc if old_cc is None else old_cc.drop("bucket").unionByName(new_cc)
        every_hc = new_hc if old_hc is None else old_hc.drop("bucket").unionByName(new_hc)
        return new_hc.join(every_cc, "city").unionByName(every_hc.join(new_cc, "city")).select("hotel_id", "city", "country").distinct()

    if "hotel_place" in kept:
        paths = keep("new_hotel_place", new_paths)

    # Hotels: their own rows, and the mean over all reviews that name them.
    put("hotel_raw", lambda: _shifted(store, "hotel_raw", raw_new.limit(0), raw_new, ["score_overall_sum", "score_overall_n"]))

    def all_hotels() -> DataFrame:
        named = base.select("hotel_id").unionByName(raw_new.select("hotel_id")).distinct()
        old = store.part("hotel", base.withColumn("average_reviews_score", F.lit(0.0)), named)
        kept = old.drop("average_reviews_score").join(base, "hotel_id", "left_anti").unionByName(base)
        # Hotels and raw sums share their buckets.
        raw = staged["hotel_raw"].result()
        raw_all = store.part("hotel_raw", raw, named).join(raw, "hotel_id", "left_anti").unionByName(raw)
        mean = F.coalesce(F.try_divide(F.col("score_overall_sum").cast("double"), F.col("score_overall_n")), F.lit(0.0))
        return kept.join(raw_all, "hotel_id", "left").select("hotel_id", *_BASE, mean.alias("average_reviews_score"))

    if "hotel" in kept:
        staged["hotel_raw"].result()  # no thread waits for another
    put("hotel", all_hotels)
    if "hotel_place" in kept:
        new_place = paths.result()
        put("hotel_place", lambda: _add(store, "hotel_place", new_place)[1])
    still = _merge_reviews(store, keep, put, staged, kept, props, people, base, asked) if "pending" in kept else None

    ready, waits = {name: f.result() for name, f in staged.items()}, still.result() if still else None
    store.replace(ready)
    if still:
        # Waiting rows are few and looked through in every merge: one table, replaced whole.
        waits.withColumn("bucket", store.bucket("pending")).write.mode("overwrite").parquet(f"{store.path}/pending")
    return store.graph(ready)


def _merge_reviews(store: GraphStore, keep: Callable, put: Callable, staged: dict[str, Future], kept: set[str], props: list[str],
                   people: DataFrame, base: DataFrame, asked: DataFrame) -> Future:
    """Put what reviews make; returns the rows that wait on (``asked``: the last
    rows of the batch and of those that waited; ``people``, ``base``: its
    travellers and hotels)."""
    keys = TABLES["pending"][1]

    # Review rows are live if both ends exist now; travellers with another segment move their reviews.
    def exists(name: str, changed: DataFrame, key: str) -> DataFrame:
        return store.part(name, changed.select(key), asked.select(key)).unionByName(changed.select(key)).distinct()

    travellers, places = (checked_broadcast(exists(*x), _BROADCAST_IDS) for x in (("traveller", people, "user_id"), ("hotel", base, "hotel_id")))

    def living(last: str) -> DataFrame:
        """Rows with a traveller, and with a hotel or without one."""
        return asked.join(travellers, "user_id", "left_semi").join(places, "hotel_id", last).select(asked.columns)

    def segments_changed() -> DataFrame:
        same = F.lit(True)
        for c in _SEGMENT:
            same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
        return store.part("traveller", people, people).alias("o").join(people.alias("n"), "user_id").where(~same).select("user_id")

    found = keep("live_review_rows", lambda: living("left_semi"))
    live = found.result()
    still = keep("merge_pending", lambda: asked.join(travellers, "user_id", "left_anti").select(asked.columns).unionByName(living("left_anti")))
    put("wrote", lambda: _add(store, "wrote", live.select("user_id", "review_id").distinct())[1])
    put("reviewed", lambda: _add(store, "reviewed", live.select("review_id", "hotel_id").distinct())[1])
    put("stayed_at", lambda: _add(store, "stayed_at", live.select("user_id", "hotel_id").distinct())[1])
    if "review_rows" not in kept:
        return still

    # Touched reviews, before and after.
    if store.table("review_rows") is None:
        before, after = live.limit(0), live
        staged["review_rows"] = found
    else:
        named = live.select("review_id")
        if "segment_stats" in kept:
            moved = keep("moved_travellers", segments_changed).result()
            wrote = store.part("wrote", live.select("user_id", "review_id"), moved)
            named = named.unionByName(wrote.join(checked_broadcast(moved, _BROADCAST_IDS), "user_id", "left_semi").select("review_id"))
        touched = keep("touched_reviews", lambda: named.distinct()).result()
        buckets, few = store.part("review_rows", live, touched), checked_broadcast(touched, _BROADCAST_IDS)
        before = keep("reviews_before", lambda: buckets.join(few, "review_id", "left_semi")).result()
        after = keep("reviews_after", lambda: before.join(live, keys, "left_anti").unionByName(live)).result()
        put("review_rows", lambda: buckets.join(few, "review_id", "left_anti").unionByName(after))
    put("review", lambda: _upsert(store, "review", _last(after, ["review_id"], props).drop("_batch", "_ord"), after.select("review_id")))
    if not {"hotel_stats", "segment_stats"} & kept:
        return still
    writers = after.select("user_id").distinct()
    were = store.part("traveller", people, writers).join(writers, "user_id", "left_semi")
    are = were.join(people, "user_id", "left_anti").unionByName(people)
    made = [keep(f"{name}_{when}", lambda f=frame: f) for when, pair in (("before", _contributions(before, were)), ("after", _contributions(after, are)))
            for name, frame in zip(("hotels", "segments"), pair) if f"{name[:-1]}_stats" in kept]
    made = [f.result() for f in made]
    half = len(made) // 2
    states = dict(zip([n for n in ("hotel_stats", "segment_stats") if n in kept], zip(made[:half], made[half:])))
    for name, more in (("hotel_stats", []), ("segment_stats", ["paths"])):
        if name in kept:
            put(name, lambda n=name, m=more: _shifted(store, n, *states[n], [*m, *_STATES, *(["base3_sum", "base3_n"] if m else [])]))
    return still


def new_store(spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, tables: tuple[str, ...] | None = None) -> GraphStore:
    return GraphStore(spark, (path or scratch_path(spark, "graph_store")).rstrip("/"), buckets, tables)
