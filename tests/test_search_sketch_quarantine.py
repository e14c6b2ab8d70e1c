"""Trigram search, quantile sketches, quarantine of bad rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplyrisk.functions import sketches
from supplyrisk.operators import search
from supplyrisk.plans import plan_text
from supplyrisk.sources import ingest

NAMES = ["Syringe 10ml", "syringe 5 ML", "Glove (L)", "glove", "Gl", "", None, "Ångström Ünit", "aaa", "aaaa", "saline bag", "Saline Bag 500ml"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(list(enumerate(NAMES)) + [(0, "second name of zero")], "id long, name string")
    return search.build(df, "id", "name", str(tmp_path_factory.mktemp("index")), buckets=8)


@pytest.mark.parametrize("text", ["syr", "SYRINGE", "ml", "ünit", "glove (", "aaaa", "aaa", "bag", "not there", "e", "", "ne b", "second"])
def test_search_equals_contains(spark, index, text):
    got = sorted((r["id"], r["name"]) for r in search.search(spark, index, text).collect())
    rows = [*enumerate(NAMES), (0, "second name of zero")]
    assert got == sorted((i, n) for i, n in rows if n is not None and text.lower() in n.lower())


def test_search_reads_only_its_folders(spark, index):
    text = plan_text(search.candidates(spark, index, "syri"), "formatted")
    line = next(x for x in text.splitlines() if "PartitionFilters" in x)
    assert "bucket" in line and 1 <= len(line.split(" IN (")[-1].split(",")) <= 2 or "bucket#" in line
    assert search.candidates(spark, index, "ab") is None


def test_index_of_nothing(spark, tmp_path):
    path = search.build(spark.createDataFrame([], "id long, name string"), "id", "name", str(tmp_path / "i"))
    assert search.search(spark, path, "abc").count() == 0 and search.search(spark, path, "a").count() == 0


def test_sketches_of_days_merge_to_the_whole(spark):
    rng = random.Random(2)
    rows = [(d, rng.choice([None, rng.gauss(d, 3)]), float(rng.randint(0, 3))) for d in range(40) for _ in range(rng.choice([1, 200, 900]))]
    df = spark.createDataFrame(rows, "day int, a double, b double").withColumn("day", F.date_add(F.lit("2020-01-01"), F.col("day")))
    days = sketches.daily(df, "day", ["a", "b"])
    assert days.count() == 40
    for q in (0.1, 0.5, 0.95):
        one = sketches.merged(days, ["a", "b"]).select(
            *[x for c in "ab" for x in (sketches.quantile(c, q).alias(c), sketches.count(c).alias(f"n_{c}"))]).first()
        for i, c in ((1, "a"), (2, "b")):
            values = [r[i] for r in rows if r[i] is not None]
            assert one[f"n_{c}"] == len(values)
            below, upto = sum(v < one[c] for v in values) / len(values), sum(v <= one[c] for v in values) / len(values)
            assert below - sketches.rank_error() <= q <= upto + sketches.rank_error()


def test_sketch_without_values(spark):
    df = spark.createDataFrame([("2020-01-01", None)], "day string, a double")
    r = sketches.merged(sketches.daily(df, "day", ["a"]), ["a"]).select(sketches.quantile("a").alias("q"), sketches.count("a").alias("n")).first()
    assert r["q"] is None and r["n"] == 0


def test_quarantine_splits_every_line(spark, tmp_path):
    header = "id,day,qty"
    good = ["1,2020-01-05,3", "2,2020-2-9,4", "7,,5", '8,"2020-03-01",6']
    bad = {"x,2020-01-05,3": ["id: not a bigint"], "3,2020-13-01,zz": ["day: not a date", "qty: not a double", "qty is positive"],
           "4,2020-01-01": ["malformed line"], "5,2020-01-01,1,2": ["malformed line"], "6,2020-01-01,-1": ["qty is positive"],
           "9,2020-01-01,": ["qty is positive"]}
    for i, lines in enumerate((good, list(bad))):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.csv").write_text("\n".join([header, *lines]) + "\n")
    raw = ingest.read_lines(spark, str(tmp_path / "in"), ["qty", "id", "day"])
    assert raw.count() == len(good) + len(bad)
    types = {"id": T.LongType(), "day": T.DateType(), "qty": T.DoubleType()}
    clean, rejected = ingest.quarantine(raw, types, str(tmp_path / "out"), {"qty is positive": F.col("qty").try_cast("double") > 0})
    assert dict(clean.dtypes) == {"qty": "double", "id": "bigint", "day": "date"}
    assert sorted(r["id"] for r in clean.collect()) == [1, 2, 7, 8]
    assert {r["raw_line"]: r["reasons"] for r in rejected.collect()} == bad


def test_quarantine_of_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n")
    raw = ingest.read_lines(spark, str(tmp_path / "a.csv"), ["id"])
    clean, rejected = ingest.quarantine(raw, {"id": T.LongType()}, str(tmp_path / "out"))
    assert clean.count() == rejected.count() == 0 and clean.columns == ["id"]
