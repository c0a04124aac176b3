"""End to end from CSV files: build, then answer a batch of questions."""

from fixtures import questions
from test_plans import plan
from tripgraph import answer_questions, build_graph_from_files
from tripgraph.plans import context as cx
from tripgraph.sources.readers import read_source


def _write(tmp_path):
    files = {
        "hotels": "hotel_id,hotel_name,city,country,star_rating,lat,lon,cleanliness_base,comfort_base,facilities_base,"
                  "location_base,staff_base,value_for_money_base\n"
                  "1,L'Hôtel Un,Paris,France,5,48.8,2.3,9.0,9.0,9.0,9,9,9\n"
                  "2,Casa Dos,Madrid,Spain,4,40.4,-3.7,8.0,8.0,8.0,8,8,8\n",
        "users": "user_id,user_gender,country,age_group,traveller_type\n10,Female,Spain,25-34,Solo\n11,Male,France,55+,Business\n",
        "reviews": "review_id,user_id,hotel_id,review_date,review_text,score_overall,score_cleanliness,score_comfort,"
                   "score_facilities,score_location,score_staff,score_value_for_money\n"
                   "r1,10,1,2024-01-01,\"Lovely, quiet\nstay\",9.0,9.5,9.0,8.0,9.0,9.0,8.0\n"
                   "r2,11,2,2024-02-01,Fine,7.0,NA,7.0,7.0,6.0,7.0,9.0\n",
        "visa": "from,to,requires_visa,visa_type\nSpain,France,No,Visa-Free / eVisa\nFrance,Spain,Yes,Tourist Visa\n",
    }
    paths = {}
    for name, text in files.items():
        p = tmp_path / f"{name}.csv"
        p.write_text(text, encoding="utf-8")
        paths[name] = str(p)
    return paths


def test_build_from_csv_and_answer(spark, tmp_path):
    paths = _write(tmp_path)
    g = build_graph_from_files(spark, paths, out=str(tmp_path / "graph"))
    assert sorted(r["name"] for r in g.hotel.collect()) == ["Casa Dos", "L'Hôtel Un"]
    q = questions(spark, ["Cleanest hotels in France", "Where do people aged 25-34 go? countries please"])
    ans = answer_questions(spark, g, q, mode=cx.HYBRID,
                           reviews=read_source(spark, "reviews", paths["reviews"]),
                           hotels=read_source(spark, "hotels", paths["hotels"]))
    ctx = {r["question_id"]: r["context"] for r in ans.context.collect()}
    assert ctx[0].startswith("Top Hotels in France (from KG):\nHotel: L'Hôtel Un (Rating: 9.0)\n\n"
                             "Cleanest Hotels (France):\nHotel: L'Hôtel Un (Cleanliness: 9.5)\n\nRelevant Text Reviews:\n")
    assert "Popular Countries for Ages ['25-34']:\nCountry: France (1 visits)" in ctx[1]
    assert [r["intent"] for r in ans.query_log.where("question_id = 0").orderBy("seq").collect()] == [
        "Country Search (France)", "Sort by Cleanest (France)"]
    edges = [(r["source"], r["rel"], r["target"]) for r in ans.edges.where("question_id = 0").orderBy("seq").collect()]
    assert edges == [("L'Hôtel Un", "LOCATED_IN", "France")]
    assert ans.prompts.count() == 2


def test_answers_read_written_tables(spark, tmp_path):
    """The prompt plan reads the written questions and index, not the graph's lineage."""
    import re

    g = build_graph_from_files(spark, _write(tmp_path), out=str(tmp_path / "graph"))
    ans = answer_questions(spark, g, questions(spark, ["Cleanest hotels in France"]), mode=cx.BASELINE)
    for df, most in ((ans.prompts, 60), (ans.edges, 25)):
        assert len(re.findall("Scan parquet|FileScan parquet", plan(df, "simple"))) <= most


def test_package_can_be_shipped(spark):
    import zipfile

    from tripgraph.session import ship_package

    names = zipfile.ZipFile(ship_package(spark)).namelist()
    assert "tripgraph/session.py" in names and "tripgraph/operators/vectors.py" in names
