from fixtures import questions, small_graph
from tripgraph.plans import context as cx
from tripgraph.plans import retrieval as R
from tripgraph.plans.questions import understand


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_scalar_forms(spark):
    g = small_graph(spark)
    assert pairs(R.hotels_by_city(g, "PARIS")) == [("Alpha", 8.5), ("Delta", 0.0)]
    assert pairs(R.hotels_by_country(g, "france")) == [("Alpha", 8.5), ("Beta", 7.0), ("Gamma", 3.5), ("Delta", 0.0)]
    assert pairs(R.hotels_by_traveller_type(g, "solo")) == [("Alpha", 8.5)]
    assert pairs(R.top_countries_by_gender(g, "female")) == [("France", 3), ("Spain", 1)]
    assert pairs(R.top_hotels_by_age_groups(g, ["18-24", "25-34"])) == [("Alpha", 8.5), ("Beta", 7.0)]
    assert pairs(R.top_countries_by_age_groups(g, ["55+"])) == [("France", 1), ("Spain", 1)]
    # city wins over country; hotels without any value of the score are left out
    assert pairs(R.best_hotels(g, "Location", city="twin", country="france")) == [("Gamma", 6.0)]
    assert pairs(R.best_hotels(g, "Cleanliness")) == [("Alpha", 9.0), ("Beta", 7.0), ("Gamma", 6.0)]
    assert pairs(R.best_hotels_global(g, "Cleanliness")) == pairs(R.best_hotels(g, "Cleanliness"))


def test_country_path_counts_each_city_country_path(spark):
    g = small_graph(spark)
    # hotel 2 and 3 are in Twin, which is in France and Spain: each review counts once per country.
    got = dict(pairs(R.best_countries_by_traveller_type(g, "business")))
    assert got == {"France": 7.0, "Spain": 7.0}


def _context(spark, texts, mode):
    g = small_graph(spark)
    q = questions(spark, texts)
    u = understand(g, q)
    heads, lines = cx.graph_lines(g, u) if mode in cx.GRAPH_MODES else (None, None)
    secs = cx.sections(heads, lines)
    return {r["question_id"]: r["context"] for r in cx.full_context(q, secs).collect()}, g, u


def test_sort_section_message_and_fallback(spark):
    ctx, g, u = _context(spark, ["cleanest hotels in italy", "tell me a story"], cx.BASELINE)
    # Italy has no hotel: no country section; the sort section prints its message.
    assert ctx[0] == "Cleanest Hotels (Italy):\nNo cleanliness data found in Italy."
    assert ctx[1] == cx.NO_CONTEXT


def test_query_log_and_prompt(spark):
    g = small_graph(spark)
    q = questions(spark, ["Solo women in Twin between 20 and 30, comfortable"])
    u = understand(g, q)
    log = [(r["seq"], r["intent"]) for r in cx.query_log(u).orderBy("seq").collect()]
    assert log == [(1, "City Search (Twin)"), (3, "Hotel by Traveller Type (Solo)"),
                   (5, "Hotel by Age Group (['18-24', '25-34'])"), (6, "Sort by Most Comfortable (Twin)")]
    heads, lines = cx.graph_lines(g, u)
    ctx = cx.full_context(q, cx.sections(heads, lines))
    p = cx.prompts(u, ctx, cx.BASELINE).first()["prompt"]
    assert "DETECTED ENTITIES: City: Twin, Traveller Type: Solo, Target Age Groups: ['18-24', '25-34'], Sort By: Comfort" in p
    assert "Most Comfortable Hotels (Twin):\nHotel: Beta (Comfort Score: 7.0)\nHotel: Gamma (Comfort Score: 6.0)" in p
    assert p.startswith("\n    You are a Hotel Recommender.\n    RETRIEVAL MODE: Baseline (Graph Only)")
    assert cx.query_log(u, cx.VECTOR).count() == 0
