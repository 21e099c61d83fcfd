from __future__ import annotations

import json

from pyspark.sql import functions as F

from reviewloom import vocab
from reviewloom.operators import evaluation, summary
from reviewloom.plans.batch import summary_document

# Published counts: (positive, neutral, negative) per aspect, and the orders they lead to.
PUBLISHED = {"delivery": (39, 3, 3), "price": (488, 24, 35), "quality": (180, 5, 11), "support": (121, 9, 20),
             "packaging": (65, 6, 7), "ux": (678, 37, 40)}
COMPLAINTS = ["support", "packaging", "delivery", "price", "quality", "ux"]
PRAISE = ["quality", "ux", "price", "delivery", "packaging", "support"]
# Published confusion matrices (rows true, columns predicted; negative, neutral, positive) and their metrics.
MATRICES = {"lexicon": [[21, 3, 34], [24, 18, 91], [106, 120, 2580]], "model": [[43, 8, 7], [40, 26, 67], [66, 141, 2599]]}
METRICS = {"lexicon": (0.874, 0.407, 0.472, 0.423), "model": (0.890, 0.470, 0.621, 0.511)}


def published_reviews(spark):
    rows = [(aspect, label, n) for aspect, counts in PUBLISHED.items() for label, n in zip(vocab.SENTIMENTS, counts)]
    df = spark.createDataFrame(rows, "aspect string, sentiment string, n int")
    df = df.select("aspect", "sentiment", F.explode(F.sequence(F.lit(1), "n"))).withColumn("dataset_id", F.lit("d"))
    return df.withColumns({f"aspect_{a}": F.col("aspect") == a for a in PUBLISHED})


def test_published_rankings(spark):
    rows = summary.aspect_summary(published_reviews(spark))
    for kind, expected in (("negative", COMPLAINTS), ("positive", PRAISE)):
        assert [r["aspect"] for r in summary.rank_aspects(rows, kind).orderBy("position").collect()] == expected
    shares = {r["aspect"]: (r["negative_share"], r["positive_share"]) for r in rows.collect()}
    assert shares["delivery"] == (0.0667, 0.8667) and shares["quality"] == (0.0561, 0.9184)


def test_summary_document(spark):
    for by in ((), ("dataset_id",)):
        document = summary_document(published_reviews(spark), by, "sentiment").toJSON().first()
        parsed = json.loads(document)
        assert (parsed["top_complaints"], parsed["top_praise"]) == (COMPLAINTS, PRAISE)
        assert parsed["aspects"]["price"] == {"total": 547, "positive": 488, "neutral": 24, "negative": 35,
                                              "negative_share": 0.064, "positive_share": 0.8921}


def judged(spark):
    parts = []
    for model, matrix in MATRICES.items():
        rows = [(t, p, n) for t, line in zip(vocab.EVALUATION_LABELS, matrix) for p, n in zip(vocab.EVALUATION_LABELS, line)]
        parts.append(spark.createDataFrame(rows, "truth string, said string, n int").select(
            "truth", F.col("said").alias(model), F.explode(F.sequence(F.lit(1), "n"))))
    return parts


def test_published_metrics(spark):
    for (model, matrix), df in zip(MATRICES.items(), judged(spark)):
        row = evaluation.classification_metrics(df, "truth", {model: model}).first()
        found = tuple(round(row[k], 3) for k in ("accuracy", "precision_macro", "recall_macro", "f1_macro"))
        assert row["n"] == 2997 and found == METRICS[model]
        cells = evaluation.confusion_matrix(df, "truth", model).orderBy("ordinal").collect()
        assert [[r[label] for label in vocab.EVALUATION_LABELS] for r in cells] == matrix


def test_published_report(spark):
    report = {r["label"]: r for r in evaluation.classification_report(judged(spark)[0], "truth", {"m": "lexicon"}).collect()}
    def line(name):
        return [round(report[name][k], 2) for k in ("precision", "recall", "f1")] + [report[name]["support"]]
    assert line("negative") == [0.14, 0.36, 0.20, 58]
    assert line("macro avg") == [0.41, 0.47, 0.42, 2997]
    assert line("weighted avg") == [0.90, 0.87, 0.89, 2997]


def test_missing_labels(spark):
    df = spark.createDataFrame([("positive", "positive"), (None, None), ("negative", None)], "truth string, said string")
    assert round(evaluation.agreement_rate(df, "truth", "said").first()[0], 4) == 0.3333
    row = evaluation.classification_metrics(df, "truth", {"m": "said"}).first()
    assert (row["n"], row["accuracy"]) == (2, 0.5)
    empty = evaluation.classification_metrics(df.limit(0), "truth", {"m": "said"}).first()
    assert (empty["accuracy"], empty["f1_macro"]) == (0.0, 0.0)


def small(spark):
    rows = [("d", 1, "positive", "2026-01-01", "box box app"), ("d", 2, "negative", "2026-01-01", "box"), ("d", 3, None, "2026-01-02", ""),
            ("d", 4, "positive", "never", None), ("e", 5, "negative", None, "zeta app")]
    return spark.createDataFrame(rows, "dataset_id string, review_id long, sentiment string, review_date string, clean_deep string")


def test_counts_and_headline(spark):
    counts = {(r["dataset_id"], r["sentiment"]): r["n"] for r in summary.sentiment_counts(small(spark)).collect()}
    assert counts == {("d", "positive"): 2, ("d", "negative"): 1, ("d", None): 1, ("e", "negative"): 1}
    rows = {r["dataset_id"]: tuple(r)[1:] for r in summary.headline_metrics(small(spark)).collect()}
    assert rows == {"d": (4, 50.0, 25.0), "e": (1, 0.0, 100.0)}
    assert tuple(summary.headline_metrics(small(spark).limit(0), by=()).first()) == (0, 0.0, 0.0)


def test_daily(spark):
    rows = sorted((r["dataset_id"], str(r["day"]), r["sentiment"], r["n"]) for r in summary.sentiment_daily(small(spark)).collect())
    assert rows == [("d", "2026-01-01", "negative", 1), ("d", "2026-01-01", "positive", 1)]
    assert {r["dataset_id"]: r["has_dates"] for r in summary.has_dates(small(spark)).collect()} == {"d": True, "e": False}


def test_words(spark):
    assert [tuple(r) for r in summary.top_words(small(spark), 2).collect()] == [("box", 3), ("app", 2)]
    assert [r["word"] for r in summary.top_words(small(spark)).collect()] == ["box", "app", "zeta"]


def test_aspect_tables(spark):
    rows = [("d", "ux", s) for s in ["negative", "negative", "positive", None]] + [("d", "price", "negative"), ("e", "ux", "neutral")]
    table = summary.aspect_sentiment_summary(spark.createDataFrame(rows, "dataset_id string, aspect string, sentiment string"))
    assert sorted(tuple(r) for r in table.collect()) == [("d", "price", 1, 0, 0, 1), ("d", "ux", 4, 1, 0, 2), ("e", "ux", 1, 0, 1, 0)]
    top = summary.top_aspects(table, "negative", 1).orderBy("dataset_id").collect()
    assert [(r["aspect"], r["negative_share"]) for r in top] == [("price", 1.0), ("ux", 0.0)]
    long = [(r["aspect"], r["sentiment"], r["n"]) for r in summary.aspect_sentiment_long(table).collect()]
    assert long[:3] == [("price", "negative", 1), ("price", "neutral", 0), ("price", "positive", 0)] and len(long) == 9


def test_unmentioned_aspects_are_zero(spark):
    df = published_reviews(spark).where("aspect = 'ux'")
    rows = summary.aspect_summary(df, by=()).collect()
    assert [r["aspect"] for r in rows] == list(vocab.ASPECT_KEYWORDS)
    assert rows[0]["total"] == 0 and rows[0]["negative_share"] == 0.0
    assert summary.rank_aspects(summary.aspect_summary(df), "negative").count() == 1


def test_each_dataset_reads_its_dates_its_own_way(spark):
    rows = [("us", "1/13/2017"), ("us", "2/1/2017"), ("uk", "13/1/2017"), ("uk", "2/1/2017"), ("uk", None), (None, "3/4/2017"), ("none", "soon")]
    df = spark.createDataFrame([(d, t, "positive") for d, t in rows], "dataset_id string, review_date string, sentiment string")
    layouts = {r.dataset_id: (r.month_first, r.day_first, r.layout) for r in summary.date_layouts(df).collect()}
    assert layouts == {"us": (2, 1, "month first"), "uk": (1, 2, "day first"), None: (1, 1, "month first"), "none": (0, 0, "month first")}
    days = {(r.dataset_id, r.review_date): r.day and r.day.isoformat() for r in summary.read_dates(df).collect()}
    assert days == {("us", "1/13/2017"): "2017-01-13", ("us", "2/1/2017"): "2017-02-01", ("uk", "13/1/2017"): "2017-01-13", ("uk", "2/1/2017"): "2017-01-02",
                    ("uk", None): None, (None, "3/4/2017"): "2017-03-04", ("none", "soon"): None}
    daily = {(r.dataset_id, str(r.day)): r.n for r in summary.sentiment_daily(df.unionByName(df)).collect()}
    assert daily == {k: 2 for k in [("us", "2017-01-13"), ("us", "2017-02-01"), ("uk", "2017-01-13"), ("uk", "2017-01-02"), (None, "2017-03-04")]}
