"""Records cut from byte ranges equal those of one pass over the whole file."""

import csv
import io
import random

import pytest

from tripgraph.sources.readers import read_source, rejected_rows
from tripgraph.sources.records import csv_records
from tripgraph.sources.schemas import REVIEWS, USERS


def quoted(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


def review(k, text):
    return [f"r{k}", k, k % 7, "2020-01-01", text, *[5.0 + k % 5] * (len(REVIEWS.fields) - 5)]


@pytest.fixture
def ranges_of(spark):
    """Byte ranges of a few bytes, so that every place of a file is an edge of some."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "0")
        spark.conf.set(keys[2], "1")

    yield use
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("size", [23, 64, 1000, 1 << 27])
def test_records_at_every_range_edge(spark, tmp_path, ranges_of, size):
    rnd = random.Random(size)
    pieces = ["plain", 'say ""so""', "line\nbreak", "\n\n", ",", "é", "", '"', "x" * 90]
    rows = [[f"{k}", "".join(rnd.choice(pieces) for _ in range(rnd.choice([0, 1, 3, 8])))] for k in range(120)]
    p = tmp_path / "t.csv"
    p.write_text(quoted([["id", "text"], *rows]))
    ranges_of(size)
    got = [r for r in csv_records(spark, str(p)).orderBy("position").collect()]
    assert [next(csv.reader(io.StringIO(r["record"]))) for r in got] == [["id", "text"], *rows]
    assert all(r["closed"] for r in got)
    if size < 100:
        assert spark.read.text(str(p)).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("size", [50, 1 << 27])
def test_reviews_equal_the_multi_line_reader(spark, tmp_path, ranges_of, size):
    texts = ["plain", 'with "quotes" in it', "two\nlines", "a, b", "", "NA", "end\r\nof it"]
    p = tmp_path / "reviews.csv"
    p.write_text(quoted([REVIEWS.fieldNames(), *[review(k, texts[k % len(texts)]) for k in range(60)]]))
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(p))
    want = sorted((r["review_id"], r["review_text"]) for r in whole.collect() if r["review_text"] not in (None, "NA"))
    ranges_of(size)
    df = read_source(spark, "reviews", str(p))
    got = df.orderBy("_ord").collect()
    assert [r["review_id"] for r in got] == [f"r{k}" for k in range(60)]
    clean = lambda t: t.replace("\r\n", "\n")
    assert sorted((r["review_id"], clean(r["review_text"])) for r in got if r["review_text"] is not None) == [(a, clean(b)) for a, b in want]


def test_several_files_and_carriage_returns(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.csv").write_bytes(quoted([["id", "text"], [f"{k}", "a\nb"], [f"{k}", "c"]]).replace("\n", "\r\n").encode())
    got = csv_records(spark, str(tmp_path)).orderBy("file", "position").collect()
    assert [r["record"] for r in got] == ["id,text", "0,\"a\r\nb\"", "0,c", "id,text", "1,\"a\r\nb\"", "1,c", "id,text", "2,\"a\r\nb\"", "2,c"]


def test_malformed_rows_are_listed(spark, tmp_path):
    p = tmp_path / "users.csv"
    head = ",".join(USERS.fieldNames())
    good = ["1,Male,Spain,18-24,Solo", '2,"Fe, male","Sp ""ai"" n",,""', "3,,,,"]
    bad = [("4,Male", "too few fields"), ("5,Male,Spain,18-24,Solo,extra", "too many fields"), ('6,"Male,Spain,18-24,Solo\nand the rest', "unbalanced quotes")]
    p.write_text("\n".join([head, *good, *[b for b, _ in bad]]))
    got = rejected_rows(spark, "users", str(p)).collect()
    assert sorted((r["record"], r["problem"]) for r in got) == sorted(bad) and all(r["file"].endswith("users.csv") for r in got)
    p.write_text("\n".join([head, *good]))
    assert rejected_rows(spark, "users", str(p)).collect() == []
