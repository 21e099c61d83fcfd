from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from reviewloom.operators import profiling as p


def test_pick_column():
    assert p.pick_column(["id", "Body", "Review Text"], ["text", "body"], ["review", "text"]) == "Review Text"
    assert p.pick_column(["id", "Body", "my_text"], ["text", "body"], ["review", "text"]) == "Body"
    assert p.pick_column(["id"], ["text"]) is None and p.pick_column([], ["text"]) is None


def test_text_column_falls_back_to_the_longest(spark):
    df = spark.createDataFrame([("abc", "x", 1), (None, "y" * 9, 2), ("abc", None, 3)], "a string, b string, n int")
    assert p.guess_text_column(df) == "b"
    tie = spark.createDataFrame([("abc", "abc")], "a string, b string")
    assert p.guess_text_column(tie) == "a"
    assert p.guess_text_column(spark.createDataFrame([(1,)], "n int")) is None
    assert p.guess_text_column(spark.createDataFrame([("s", "long text")], "comment string, b string")) == "comment"


def test_column_roles(spark):
    df = spark.createDataFrame([("good stuff, all of it", "4", "2026-01-02"), ("bad", "x", "soon")], "words string, score string, `day.time` string")
    rows = {r["column_name"]: r for r in p.column_roles(df).collect()}
    assert [rows[c]["role"] for c in df.columns] == ["text", "rating", "date"]
    assert rows["score"]["numeric_share"] == 0.5 and rows["day.time"]["date_share"] == 0.5


def test_nulls_and_duplicates(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, None), (5, "b"), (6, "a")]
    df = spark.createDataFrame(rows, "review_id long, review_text string")
    assert {r["column_name"]: r["nulls"] for r in p.null_counts(df).collect()} == {"review_id": 0, "review_text": 2}
    assert p.duplicate_count(df).first()[0] == 3
    assert sorted(r["review_id"] for r in p.duplicate_rows(df, "review_id").collect()) == [2, 4, 6]
    assert p.duplicate_count(df.limit(0)).first()[0] == 0


def test_first_rows(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("review_id"))
    assert [r[0] for r in p.first_rows(df, 3).collect()] == [0, 1, 2]


def test_ratings_and_words(spark, reviews):
    assert [tuple(r) for r in p.rating_distribution(reviews).collect()] == [(1.0, 2), (2.0, 1), (3.0, 1), (4.0, 1), (5.0, 2)]
    assert p.average_words(reviews).first()[0] == 5.6
    assert {r["rating"]: r["avg_words"] for r in p.average_words(reviews, ["rating"]).collect()}[3.0] == 3.0
    parts = p.summarize_reviews(reviews)
    assert parts["rows"].first()[0] == 7 and parts["samples"].count() == 3


def test_histogram_equals_numpy(spark):
    draw = np.random.default_rng(4)
    for values in (draw.integers(0, 300, 500), np.full(5, 7), draw.integers(3, 5, 40)):
        df = spark.createDataFrame([(int(v),) for v in values] + [(None,)], "word_count int")
        rows = p.word_count_histogram(df).collect()
        counts, edges = np.histogram(values, bins=20)
        assert [r["n"] for r in rows] == counts.tolist()
        assert np.allclose([r["bin_start"] for r in rows], edges[:-1])
    assert p.word_count_histogram(spark.createDataFrame([(None,)], "word_count int")).count() == 0


def test_fingerprint_follows_the_content(spark):
    rows = [(i, f"t{i}") for i in range(50)]

    def mark(some):
        df = spark.createDataFrame(some, "n int, s string")
        return p.dataset_fingerprint(df.repartition(5), "up").first()["fingerprint"]
    base = mark(rows)
    assert base.startswith("up_") and len(base) == 13
    assert base == mark(rows[::-1])
    assert base != mark(rows + rows[:1]) and mark(rows + rows[:1]) != mark(rows + rows[:1] * 3)
    assert base != mark([(None, s) if n == 3 else (n, s) for n, s in rows])


def test_loader_profile_is_one_table(spark, reviews):
    rows = [(r.part, r.ordinal, r.name, r.value) for r in p.loader_profile(reviews).collect()]
    assert ("rows", 0, "rows", "7") in rows and ("rating", 0, "1.0", "2") in rows and ("column", 1, "review_text", "string") in rows
    assert [r[2] for r in sorted(rows) if r[0] == "sample"] == ["1", "2", "3"]
    bare = {(r.part, r.name): r.value for r in p.loader_profile(reviews.drop("rating").limit(0)).collect()}
    assert bare["rows", "rows"] == "0" and bare["words", "mean"] is None
