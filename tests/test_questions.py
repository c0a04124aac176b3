import pytest

from fixtures import questions, small_graph
from tripgraph.operators.linking import entity_dictionary, link_entities
from tripgraph.plans.questions import understand


def understood(spark, texts):
    g = small_graph(spark)
    return {r["user_query"]: r for r in understand(g, questions(spark, texts)).collect()}


@pytest.mark.parametrize("text,groups", [
    ("people between 18 and 40", ["18-24", "25-34", "35-44"]),
    ("aged 25-34", ["25-34"]),
    ("aged 25–34", None),            # en dash: no match
    ("from 34 to 25", None),         # reversed: no overlap
    ("101-110 year olds", None),     # above every group
    ("2 and 3 beds", None),          # matches, overlaps nothing
    ("55+ guests", None),
    ("aged 60 to 70", ["55+"]),
])
def test_age_groups(spark, text, groups):
    r = understood(spark, [text])[text]
    assert (list(r["age_groups"]) if r["age_groups"] is not None else None) == groups


@pytest.mark.parametrize("text,sort_by", [
    ("clean and cozy rooms", "Comfort"),          # later list overrides
    ("good value, central", "Location"),
    ("hygiene first", "Cleanliness"),
    ("a devalued deal", "Value"),                 # substring, no word boundary
    ("tell me a story", None),
])
def test_sort_intent(spark, text, sort_by):
    assert understood(spark, [text])[text]["sort_by"] == sort_by


def test_country_mode(spark):
    u = understood(spark, ["the countryside", "which countries", "hotels please"])
    assert [u[t]["country_mode"] for t in ("the countryside", "which countries", "hotels please")] == [True, True, False]


def test_linking_longest_and_case_insensitive(spark):
    g = small_graph(spark)
    q = questions(spark, ["FEMALE guests in twin, spain", "nothing here", "male"])
    links = {(r["question_id"], r["category"]): r["value"] for r in link_entities(q, entity_dictionary(g)).collect()}
    assert links[(0, "Gender")] == "Female"        # 'male' is inside 'female'; longest wins
    assert links[(0, "City")] == "Twin"
    assert links[(0, "Country")] == "Spain"
    assert links[(2, "Gender")] == "Male"
    assert not any(k[0] == 1 for k in links)


def test_age_group_category_not_linked(spark):
    g = small_graph(spark)
    q = questions(spark, ["we are 25-34"])
    cats = {r["category"] for r in link_entities(q, entity_dictionary(g)).collect()}
    assert "Age Group" not in cats


def test_linking_equals_all_pairs(spark, monkeypatch):
    """Against every question with every value; parts of two values split the common keys."""
    import random

    from pyspark.sql import functions as F
    from tripgraph.operators import linking

    monkeypatch.setattr(linking, "PART_VALUES", 2)
    rnd = random.Random(8)
    syllables = ["pa", "ris", "lon", "don", "é", "x", "hotel ", "ber", "lin", " "]
    name = lambda n: "".join(rnd.choice(syllables) for _ in range(n))
    values = {(c, name(rnd.choice([1, 1, 2, 3, 5]))) for c in ("City", "Hotel", "Country") for _ in range(40)}
    values |= {("City", "x"), ("City", "PA"), ("Hotel", "É"), ("City", "Paris"), ("City", "pARIS"), ("Age Group", "18-24")}
    values = {(c, v) for c, v in values if v}
    asked = [(k, name(rnd.choice([0, 1, 4, 12])).title()) for k in range(150)] + [(900, None), (901, ""), (902, "p"), (903, "PARISIAN x 18-24")]
    d = spark.createDataFrame(sorted(values), "category string, value string")
    q = spark.createDataFrame(asked, "question_id bigint, user_query string")
    want = set()
    for i, t in asked:
        for c in ("City", "Hotel", "Country"):
            found = [v for k, v in values if k == c and t is not None and v.lower() in t.lower()]
            if found:
                want.add((i, c, min(found, key=lambda v: (-len(v), v))))
    assert {tuple(r) for r in linking.link_entities(q, d).collect()} == want
    same = spark.range(50).selectExpr("'c' || id AS category", "'Abc' AS value", "'abc' AS v_lc", "3 AS v_len")
    assert linking._keyed_values(same).groupBy("gram", "part").count().agg(F.max("count"), F.sum("count")).first()[0] < 10
    assert linking.link_entities(q, d.limit(0)).collect() == []
