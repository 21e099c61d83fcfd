from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from reviewloom import analyze, vocab
from reviewloom.operators import scoring
from reviewloom.plans import batch


def test_analyze_adds_its_columns(reviews):
    rows = {r["review_id"]: r for r in analyze(reviews).collect()}
    flags = [f"aspect_{a}" for a in vocab.ASPECT_KEYWORDS]
    assert set(reviews.columns) | {"clean_light", "clean_deep", "word_count", "sentiment", "confidence", "aspects", *flags} == set(analyze(reviews).columns)
    assert all(r["sentiment"] in vocab.SENTIMENTS and 0.0 <= r["confidence"] <= 1.0 for r in rows.values())
    assert rows[1]["aspects"] == ["delivery"] and rows[5]["aspects"] == ["delivery", "packaging"] and rows[7]["aspects"] == []
    assert (rows[2]["sentiment"], rows[3]["sentiment"], rows[4]["sentiment"]) == ("negative", "positive", "negative")


def test_analyze_needs_the_text(spark):
    with pytest.raises(KeyError):
        analyze(spark.range(1))


def test_analyze_with_a_brought_model(reviews):
    rows = analyze(reviews, load_model=lambda: lambda texts: [("LABEL_1", 0.25) for _ in texts]).collect()
    assert {(r["sentiment"], r["confidence"]) for r in rows} == {("neutral", 0.25)}


def test_analyze_does_not_shuffle(reviews):
    plan = analyze(reviews)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_unused_results_are_not_computed(reviews):
    plan = analyze(reviews).select("review_id", "aspects")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_analyze_on_a_stream(spark, reviews, tmp_path):
    reviews.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = analyze(spark.readStream.schema(reviews.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start())
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("review_id", "sentiment", "aspects")
    assert sorted(found.collect()) == sorted(analyze(reviews).select("review_id", "sentiment", "aspects").collect())


def test_batch_chain(spark, reviews, tmp_path):
    paths = batch.BatchPaths(str(tmp_path))
    many = reviews.crossJoin(spark.range(10).withColumnRenamed("id", "copy")).withColumn("review_id", F.col("copy") * 10 + F.col("review_id")).drop("copy")
    blank = spark.createDataFrame([(900, " ", 1.0, None)], reviews.schema)
    assert batch.clean_stage(many.unionByName(blank), paths).count() == 70
    assert batch.sentiment_stage(spark, paths, sample=60).count() == 60
    tables = batch.evaluation_stage(spark, paths)
    metrics = {r["model"]: r for r in tables["metrics"].collect()}
    assert set(metrics) == {"lexicon", "model"} and metrics["model"]["accuracy"] > 0.9
    assert spark.read.text(f"{paths.sentiment_comparison}/report").count() == 12
    stored = batch.aspect_stage(spark, paths, topics=2)
    assert stored.count() == 60 and "topic" in stored.columns
    summary = json.loads(spark.read.text(paths.aspect_summary).first()[0])
    assert set(summary) == {"aspects", "top_complaints", "top_praise"} and list(summary["aspects"]) == list(vocab.ASPECT_KEYWORDS)


@pytest.fixture
def many(spark, reviews):
    rows = reviews.crossJoin(spark.range(40).withColumnRenamed("id", "copy"))
    words = F.concat_ws(" ", "review_text", *[F.concat(F.lit(w), ((F.col("copy") + F.col("review_id")) % m).cast("string")) for w, m in (("odd", 5), ("rare", 11), ("word", 17))])
    return rows.select((F.col("copy") * 10 + F.col("review_id")).alias("review_id"), words.alias("review_text"), "rating", "review_date").repartition(3)


def test_parts_score_as_the_whole(spark, many, tmp_path, monkeypatch):
    """Texts meet the scores of their words in broadcasts of one part, with no shuffle; all rows are there once."""
    monkeypatch.setattr(scoring, "HEAD", 8)
    paths = batch.BatchPaths(str(tmp_path / "b"))
    clean = batch.clean_stage(many, paths)
    model = scoring.fit_sentiment_model(clean)
    expected = scoring.run_sentiment(clean, model, key=batch.ROW_KEY).drop(batch.ROW_KEY)
    plans, run = [], batch.run_sentiment
    monkeypatch.setattr(batch, "run_sentiment", lambda *a, **b: (plans.append(run(*a, **b)), plans[-1])[1])
    for size, rounds in ((1000, 1), (40, 3)):
        monkeypatch.setattr(batch, "PART_ROWS", size)
        monkeypatch.setattr(batch, "ROUNDS", rounds)
        plans.clear()
        scored = batch.sentiment_stage(spark, paths, model=model)
        assert len(plans) == (1 if size == 1000 else len(batch.row_parts(clean, batch.ROW_KEY, 40))) and scored.columns == expected.columns
        found = {r["review_id"]: r for r in scored.collect()}
        assert scored.count() == 280 == len(found)
        for r in expected.collect():
            mine = found[r["review_id"]].asDict()
            assert mine.pop("transformer_confidence") == pytest.approx(r["transformer_confidence"], abs=1e-12)
            assert mine == {k: v for k, v in r.asDict().items() if k != "transformer_confidence"}
        shown = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
        assert all("BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p for p in shown)


def test_parts_cover_all_rows(spark, many, tmp_path):
    paths = batch.BatchPaths(str(tmp_path / "b"))
    clean = batch.clean_stage(many, paths)
    keys = sorted(r[0] for r in clean.select(batch.ROW_KEY).collect())
    for size in (7, 100, 1000):
        parts = batch.row_parts(clean, batch.ROW_KEY, size)
        inside = [[k for k in keys if first <= k <= last] for first, last, _ in parts]
        assert [len(p) for p in inside] == [n for *_, n in parts] and max(map(len, inside)) <= size
        assert [k for p in inside for k in p] == keys


def test_a_failed_part_leaves_the_stored_table(spark, many, tmp_path, monkeypatch):
    paths = batch.BatchPaths(str(tmp_path / "b"))
    batch.clean_stage(many, paths)
    assert batch.sentiment_stage(spark, paths).count() == 280
    monkeypatch.setattr(batch, "PART_ROWS", 100)
    runs, run = [], batch.run_sentiment
    monkeypatch.setattr(batch, "run_sentiment", lambda *a, **b: run(*a, **b) if not runs.append(1) and len(runs) < 3 else pytest.fail("no third part"))
    with pytest.raises(pytest.fail.Exception):
        batch.sentiment_stage(spark, paths)
    assert batch.read_stage(spark, paths.reviews_sentiment).count() == 280
