import pytest
from pyspark.sql import functions as F

from fixtures import small_graph
from tripgraph.operators.graph import last_wins, read_graph, write_graph
from tripgraph.plans.text import FEATURE_FIELDS, feature_docs, read_vectors, write_vectors
from tripgraph.sources.readers import BadIds, MissingInputs, read_source, read_sources, rejected_ids, require_inputs


def test_csv_scan_schema_tokens_and_multiline(spark, tmp_path):
    p = tmp_path / "reviews.csv"
    p.write_text(
        "review_id,user_id,hotel_id,review_date,review_text,score_overall,score_cleanliness,score_comfort,"
        "score_facilities,score_location,score_staff,score_value_for_money\n"
        'r1,1,2,2020-01-01,"great, quiet\nroom",8.5,NA,9,9,9,9,9\n'
        "r2,1,2,2020-01-02,n/a,nan,7,,9,9,9,9\n")
    df = read_source(spark, "reviews", str(p))
    rows = {r["review_id"]: r for r in df.collect()}
    assert rows["r1"]["review_text"] == "great, quiet\nroom"
    assert rows["r1"]["score_cleanliness"] is None and rows["r1"]["score_overall"] == 8.5
    assert rows["r2"]["review_text"] is None and rows["r2"]["score_overall"] is None
    assert rows["r2"]["score_comfort"] is None
    assert dict(df.dtypes)["user_id"] == "bigint"


def test_visa_header_and_string_flag(spark, tmp_path):
    p = tmp_path / "visa.csv"
    p.write_text("from,to,requires_visa,visa_type\nA,B,1,Tourist Visa\nA,C,True,x\nB,A,No,y\n")
    df = read_source(spark, "visa", str(p))
    assert df.columns[:4] == ["from_country", "to_country", "requires_visa", "visa_type"]
    assert sorted(r["requires_visa"] for r in df.collect()) == ["1", "No", "True"]


def test_missing_inputs_are_all_named(spark, tmp_path):
    there = tmp_path / "there.csv"
    there.write_text("x\n")
    a, b, c = str(tmp_path / "a.csv"), f"file://{tmp_path}/b.csv", f"file:{tmp_path}/c.csv"
    with pytest.raises(MissingInputs) as e:
        require_inputs(spark, [a, str(there), f"file://{there}", b, c])
    assert all(p in str(e.value) for p in (a, b, c)) and "there" not in str(e.value)
    with pytest.raises(MissingInputs):
        read_sources(spark, {"hotels": a})


USERS = "user_id,user_gender,country,age_group,traveller_type\n"


def test_ids_with_a_zero_fraction_are_ids_and_others_are_refused(spark, tmp_path):
    p = tmp_path / "users.csv"
    p.write_text(USERS + "10.0,Female,Spain,25-34,Solo\n11,Male,  ,55+,Solo\n1e2,Male,France, NA,Solo\n,Male,France,55+,Solo\n")
    rows = {r["user_id"]: r for r in read_source(spark, "users", str(p)).collect()}
    assert set(rows) == {10, 11, 100, None}
    assert rows[11]["country"] == "  " and rows[100]["age_group"] == " NA"   # padded text is text
    assert read_sources(spark, {"users": str(p)})["users"].count() == 4
    p.write_text(USERS + "10.5,Female,Spain,25-34,Solo\nabc,Male,Spain,55+,Solo\n12,Male,Spain,55+,Solo\n")
    assert sorted(r["user_id"] for r in rejected_ids(spark, "users", str(p)).collect()) == ["10.5", "abc"]
    with pytest.raises(BadIds, match="abc"):
        read_sources(spark, {"users": str(p)})


def test_order_column_decides_over_files(spark, tmp_path):
    path = str(tmp_path / "users")
    rows = [(1, "Female", "Spain", "25-34", "Solo", 2), (1, "Male", "France", "55+", "Group", 1)]
    for r in rows:
        spark.createDataFrame([r], "user_id bigint, user_gender string, country string, age_group string, traveller_type string, at int").coalesce(
            1).write.mode("append").parquet(path)
    df = read_source(spark, "users", path, "parquet", order_col="at")
    assert [r["country"] for r in last_wins(df, "user_id", ["country"]).collect()] == ["Spain"]
    with pytest.raises(ValueError):
        read_source(spark, "users", path, "csv", order_col="at")


def test_only_reviews_look_for_quoted_line_breaks(spark, tmp_path):
    p = tmp_path / "users.csv"
    p.write_text(USERS + '1,"Fe\nmale",Spain,25-34,Solo\n')
    assert read_source(spark, "users", str(p)).count() == 2
    assert read_source(spark, "users", str(p), multi_line=True).count() == 1


def test_feature_sentence_without_a_hotel_id(spark):
    reviews = spark.createDataFrame([("r", None, None)], "review_id string, hotel_id bigint, review_text string").selectExpr(
        "*", *[f"CAST(NULL AS DOUBLE) AS {c}" for _, c in FEATURE_FIELDS])
    hotels = spark.createDataFrame([(1, "A")], "hotel_id bigint, hotel_name string")
    assert feature_docs(reviews, hotels).first()["text"].startswith("Hotel: Unknown Hotel (ID: nan). Cleanliness: 0.0, ")


def test_other_read_errors_are_not_an_absent_store(spark, tmp_path):
    (tmp_path / "part.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        read_vectors(spark, str(tmp_path), "M")


def test_graph_sink_round_trip_and_overwrite(spark, tmp_path):
    g = small_graph(spark)
    path = str(tmp_path / "graph")
    write_graph(g, path)
    write_graph(g, path)            # full refresh: same content, no duplicates
    back = read_graph(spark, path)
    for name, df in g.tables().items():
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, getattr(back, name).select(*df.columns).collect())), name


def test_vector_store_per_model(spark, tmp_path):
    path = str(tmp_path / "vec")
    v = spark.createDataFrame([(1, 10, "a", [0.1, 0.2]), (2, 11, "b", [0.3, 0.4])],
                              "doc_id bigint, hotel_id bigint, text string, embedding array<float>")
    write_vectors(v, path, "MiniLM")
    write_vectors(v.limit(1), path, "MPNet")
    write_vectors(v.where("doc_id = 2"), path, "MiniLM")    # replaces MiniLM only
    assert [r["doc_id"] for r in read_vectors(spark, path, "MiniLM (Fast)").collect()] == [2]
    assert read_vectors(spark, path, "MPNet (Accurate)").count() == 1
    assert read_vectors(spark, path, "Other") is None
    assert read_vectors(spark, str(tmp_path / "absent"), "MiniLM") is None
