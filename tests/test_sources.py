import json

import pytest
from pyspark.sql import functions as F

from tables import table
from recspark.functions import text
from recspark.models.popularity import Popularity
from recspark.operators import split, textprofiles
from recspark.sources import artifacts, reviews, tracking


@pytest.fixture
def raw(tmp_path):
    good = {"reviewerID": "u1", "asin": "i1", "overall": 5, "summary": "  Nice  ",
            "reviewText": "t", "verified": True, "style": {"Color:": "Red"}, "reviewerName": "Ann"}
    lines = [
        json.dumps(good),
        "",
        "{broken",
        json.dumps({**good, "overall": "4.0", "asin": "i2", "reviewerName": " "}),
        json.dumps({**good, "overall": 6}),
        json.dumps({**good, "overall": "many"}),
        json.dumps({**good, "reviewerID": ""}),
        json.dumps({"reviewerID": "u2", "asin": "i1", "overall": 1, "reviewerName": "Bo"}),
    ]
    path = tmp_path / "raw.json"
    path.write_text("\n".join(lines))
    return str(path)


def test_lenient_scan(spark, raw):
    df = reviews.load_reviews(spark, raw)
    assert table(df, "user_id", "item_id", "rating") == [
        ("u1", "i1", 5.0), ("u1", "i2", 4.0), ("u2", "i1", 1.0)]
    row = df.filter("user_id = 'u2'").first()
    assert row["reviewText"] == "" and row["verified"] is None and row["style"] is None


def test_audit(spark, raw):
    row = reviews.audit_jsonl(spark, raw).first()
    assert (row["n_rows"], row["n_corrupt"], row["n_missing_id"], row["n_bad_rating"],
            row["n_usable"], row["is_valid"]) == (7, 1, 1, 2, 3, False)


def test_strict_scan_fails_on_damage(spark, raw):
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        reviews.load_prepared(spark, raw).collect()


def test_split_sink_and_subset(spark, raw, tmp_path):
    df = reviews.load_reviews(spark, raw).withColumn(
        "row_key", split.split_key(42, "user_id", "item_id"))
    out = split.split_per_user(df).drop("row_key", "ingest_order")
    sizes = reviews.write_split(out, str(tmp_path / "s"), "json")
    assert sizes == {"train_rows": 1, "test_rows": 2}  # one row of two; a single row tests
    back = reviews.load_prepared(spark, str(tmp_path / "s"))
    assert back.count() == 3
    keep = spark.createDataFrame([("u1",)], "user_id string")
    assert reviews.write_user_subset(back, keep, str(tmp_path / "sub")) == 2


def test_titles_names_and_labels(spark, raw, tmp_path):
    meta = tmp_path / "meta.json"
    meta.write_text("\n".join(json.dumps(r) for r in [
        {"asin": "i1", "title": "", "brand": "Acme"},
        {"asin": "i1", "title": "Brush", "brand": "Acme"},
        {"asin": "i1", "title": "Other", "brand": "Acme"},
        {"asin": "i3", "title": "Acme pen", "brand": "ACME"},
    ]))
    titles = reviews.item_titles(reviews.load_item_metadata(spark, str(meta)))
    assert table(titles, "item_id", "title") == [("i1", "Brush - Acme"), ("i3", "Acme pen")]
    names = reviews.reviewer_names(reviews.load_raw(spark, raw))
    assert table(names, "user_id", "name") == [("u1", "Ann"), ("u2", "Bo")]
    shown = reviews.display_titles(
        titles, reviews.fallback_titles(reviews.load_reviews(spark, raw)))
    assert ("i2", "Nice") in table(shown, "item_id", "title")
    labels = reviews.display_labels(
        spark.createDataFrame([("i1",), ("i9",)], "item_id string"), shown, "item_id", "title", "l")
    assert table(labels, "item_id", "l") == [("i1", "Brush - Acme [i1]"), ("i9", "i9")]


def test_results_table(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([(0.5, 1, "x")], "MAE double, n int, note string")
    tracking.log_metrics([tracking.metric_rows(one, "r1", "M", "rating")], path)
    two = spark.createDataFrame([(0.25,)], "NDCG double")
    tracking.log_metrics([tracking.metric_rows(two, "r1", "M", "ranking")], path)
    log = spark.read.parquet(path)
    assert set(table(log, "metric")) == {("MAE",), ("n",), ("NDCG",)}
    row = tracking.results_table(log).first()
    assert row["MAE"] == 0.5 and row["NDCG"] == 0.25 and row["RMSE"] is None


def test_fit_or_load(spark, skewed, tmp_path):
    fits = []

    def fit():
        fits.append(1)
        return Popularity.fit(skewed)

    args = (spark, Popularity, fit, str(tmp_path), "exp", "Popularity Model!")
    first = artifacts.fit_or_load(*args)
    again = artifacts.fit_or_load(*args)
    users = skewed.select("user_id").distinct()
    assert len(fits) == 1 and table(first.rank(users, 3)) == table(again.rank(users, 3))
    with pytest.raises(FileNotFoundError):
        artifacts.fit_or_load(spark, Popularity, fit, str(tmp_path), "exp", "none", eval_only=True)


def test_a_writer_that_stops_leaves_the_last_version(spark, skewed, tmp_path):
    place = (str(tmp_path), "exp", "pop")
    whole = Popularity.fit(skewed)
    artifacts.save_model(whole, *place)

    class Stopped(Popularity):
        def tables(self):
            broken = self.seen.select(F.raise_error(F.lit("stopped")).cast("string").alias("x"))
            return {"order": self.order.limit(1), "seen": broken}

    with pytest.raises(Exception, match="stopped"):
        artifacts.save_model(Stopped.fit(skewed), *place)
    again = artifacts.load_model(spark, Popularity, *place)
    assert table(again.order) == table(whole.order)
    assert artifacts.model_versions(spark, *place).count() == 1


def test_versions_are_kept_and_the_latest_is_read(spark, skewed, tmp_path):
    place = (str(tmp_path), "exp", "pop")
    assert not artifacts.has_model(spark, *place)
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, Popularity, *place)
    part = Popularity.fit(skewed.filter("user_id < 10"))
    first = artifacts.save_model(part, *place).rsplit("/", 1)[1]
    artifacts.save_model(Popularity.fit(skewed), *place)
    assert artifacts.model_versions(spark, *place).count() == 2
    old = artifacts.load_model(spark, Popularity, *place, version=first)
    new = artifacts.load_model(spark, Popularity, *place)
    assert table(old.order) == table(part.order) != table(new.order)


def test_unknown_user_and_item(spark, skewed):
    model = Popularity.fit(skewed)
    stranger = spark.createDataFrame([(999,)], "user_id long")
    top = [r["item_id"] for r in model.popular_items(3).collect()]
    got = [r["item_id"] for r in model.rank(stranger, 3).orderBy("rank").collect()]
    assert got == top
    mean = model.mean.first()[0]
    pair = spark.createDataFrame([(1, 777)], "user_id long, item_id long")
    assert model.predict(pair).first()["prediction"] == pytest.approx(mean)
    heavy = spark.createDataFrame([(0,)], "user_id long")
    everything = skewed.select(F.lit(0).cast("long").alias("user_id"), "item_id").distinct()
    assert model.rank(heavy, 3, everything).count() == 0


@pytest.mark.parametrize("rating,want", [
    ("5", "5 star rating"), ("4.5", "4.5 star rating"), ("0", ""), ("x", ""), (None, "")])
def test_rating_phrase(spark, rating, want):
    df = spark.createDataFrame([(rating,)], "r string")
    assert df.select(text.rating_phrase("r")).first()[0] == want


def test_snippet(spark):
    df = spark.createDataFrame(
        [(4.0, "Yes", {"Size:": " L  x ", "Color": None, "Brand:": "B"}, " a\n b ", "c"),
         (None, None, None, None, None)],
        "rating double, verified string, style map<string,string>, summary string, "
        "reviewText string")
    got = [r[0] for r in df.select(text.review_snippet()).collect()]
    assert got == ["4 star rating verified purchase Brand B Size L x a b c", ""]


def test_terms(spark):
    docs = spark.createDataFrame([(1, "The red pen, a RED pen")], "id int, doc string")
    got = table(textprofiles.term_counts(docs, "id", ["the"]), "term", "tf")
    assert got == sorted([("red", 2), ("pen", 2), ("red pen", 2), ("pen red", 1)], key=str)


def test_text_index_needs_enough_items(spark):
    rows = [(1, i, 5.0, "s", "some text that is long enough to count", None, None, i)
            for i in range(9)]
    df = spark.createDataFrame(
        rows, "user_id int, item_id int, rating double, summary string, reviewText string, "
              "verified string, style map<string,string>, row_key int")
    with pytest.raises(ValueError):
        textprofiles.TextProfiles.fit(df)
