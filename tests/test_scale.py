"""Plans that must hold on large inputs, and exactness when one group holds a third of the rows."""

from __future__ import annotations

import time

import pytest

from collections import Counter


from pyspark.sql import functions as F

from reviewloom.operators import aspects, cleaning, profiling, strategy, summary, topics
from reviewloom.plans.analyze import analyze
from reviewloom.operators.scoring import score_lexicon
from reviewloom.sources.store import ReviewStore


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 reviews; a third share one dataset, text and date."""
    i = F.col("id")
    third = i % 3 == 0
    return spark.range(3000).select(
        i.alias("review_id"), F.when(third, "hot").otherwise(F.concat(F.lit("d"), (i % 7).cast("string"))).alias("dataset_id"),
        F.when(third, "Late box, awful!").otherwise(F.concat(F.lit("Good price number "), (i % 500).cast("string"))).alias("review_text"),
        (1 + i % 5).cast("double").alias("rating"), F.lit("2026-01-01").alias("review_date"))


def test_hot_text_duplicates(hot):
    rows = hot.select("review_id", "review_text").collect()
    firsts = {}
    for r in sorted(rows):
        firsts.setdefault(r["review_text"], r["review_id"])
    expected = {r["review_id"] for r in rows} - set(firsts.values())
    assert {r["review_id"] for r in profiling.duplicate_rows(hot, "review_id").collect()} == expected
    assert profiling.duplicate_count(hot).first()[0] == len(expected)
    plan = plan_of(profiling.duplicate_rows(hot, "review_id"))
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_hot_dataset_is_saved_whole(spark, hot, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "s"))
    store.save_analysis(analyze(hot))
    assert store.reviews("hot").count() == 1000 and store.aspects("hot").count() == 2000
    counts = {(r["dataset_id"], r["sentiment"]): r["n"] for r in summary.sentiment_counts(store.reviews()).collect()}
    assert counts[("hot", "negative")] == 1000 and sum(counts.values()) == 3000
    examples = strategy.negative_examples(store.aspects(), store.reviews()).where("dataset_id = 'hot'").collect()
    assert sorted((r["aspect"], r["review_id"]) for r in examples) == [(a, i) for a in ("delivery", "packaging") for i in (0, 3, 6)]


def test_hot_word_counts(hot):
    words = Counter(w for r in cleaning.preprocess(hot).collect() for w in r["clean_deep"].split())
    found = {r["word"]: r["n"] for r in summary.word_frequencies(cleaning.preprocess(hot)).collect()}
    assert found == words and words["late"] == 1000


def test_rank_limit_comes_before_the_shuffle(spark, tmp_path, hot):
    store = ReviewStore(spark, str(tmp_path / "s"))
    store.save_analysis(analyze(hot))
    plan = plan_of(strategy.negative_examples(store.aspects(), store.reviews()))
    first_limit = plan.index("WindowGroupLimit")
    assert "Partial" in plan and first_limit < plan.index("Exchange hashpartitioning") < plan.rindex("Partial")
    assert "PushedFilters: [IsNotNull(sentiment), EqualTo(sentiment,negative)" in plan or "EqualTo(sentiment,negative)" in plan


def test_one_dataset_reads_one_partition(spark, tmp_path, hot):
    store = ReviewStore(spark, str(tmp_path / "s"))
    store.save_analysis(analyze(hot))
    plan = plan_of(summary.sentiment_counts(store.reviews("hot")))
    assert "(dataset_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "ReadSchema: struct<sentiment:string>" in plan


def test_exploding_tags_does_not_compute_them_twice(spark, hot, tmp_path):
    hot.write.parquet(str(tmp_path / "t"))
    tagged = aspects.tag_aspects(cleaning.preprocess(spark.read.parquet(str(tmp_path / "t"))))
    plan = plan_of(aspects.aspect_rows(tagged, "dataset_id").groupBy("dataset_id", "aspect").count())
    assert "DataFilters: []" in plan


def test_histogram_reads_its_input_once(spark, hot):
    df = cleaning.preprocess(hot)
    histogram = profiling.word_count_histogram(df)
    assert sum(r["n"] for r in histogram.collect()) == 3000
    assert "ReusedExchange" in plan_of(histogram)


def test_topic_terms_are_combined_before_the_shuffle(hot):
    plan = plan_of(topics.topic_terms(hot, "dataset_id", "review_text"))
    assert plan.index("Exchange hashpartitioning") < plan.index("partial_count")


def test_a_save_reads_no_older_dataset(spark, tmp_path, monkeypatch):
    store = ReviewStore(spark, str(tmp_path))
    rows = [(1, "fine", "positive", 0.5, ["price"], "old")]
    schema = "review_id long, review_text string, sentiment string, confidence double, aspects array<string>, dataset_id string"
    store.save_analysis(spark.createDataFrame(rows, schema))
    monkeypatch.setattr(store, "_read", lambda table: pytest.fail("the store was read"))
    store.save_analysis(spark.createDataFrame([(*rows[0][:5], "new")], schema))
    monkeypatch.undo()
    assert {r.dataset_id for r in store.reviews().collect()} == {"old", "new"} == {r.dataset_id for r in store.aspects().collect()}


def test_context_scorer_is_linear_in_capitals(spark):
    def seconds(text):
        df = spark.createDataFrame([(text,)] * 2, "clean_light string").coalesce(1)
        started = time.perf_counter()
        score_lexicon(df).collect()
        return time.perf_counter() - started
    small = " ".join(["good"] * 16_000)
    seconds("good")
    assert seconds(small.upper()) < 2 * seconds(small) + 2


def test_a_save_of_numbered_reviews_writes_them_once(spark, hot, tmp_path, monkeypatch):
    from reviewloom.sources import store as module
    staged = []
    remove = module.remove_path
    monkeypatch.setattr(module, "remove_path", lambda spark, path: (staged.append(module.path_exists(spark, path)), remove(spark, path)))
    store = ReviewStore(spark, str(tmp_path / "s"))
    store.save_analysis(analyze(hot))
    assert staged == [False] and store.reviews().count() == 3000 and store.aspects("hot").count() == 2000
    store.save_analysis(analyze(hot.drop("review_id")), "own")
    assert staged == [False, True] and store.reviews("own").select("review_id").distinct().count() == 3000


def test_texts_are_not_shuffled_for_the_examples(spark, hot, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "s"))
    store.save_analysis(analyze(hot))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        context = strategy.strategy_context(store.reviews(), store.aspects())
        text = [line for line in plan_of(context).splitlines() if "Join" in line and "review_id" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(text) == 1 and "BroadcastHashJoin" in text[0]


def test_rare_words_are_listed_once(spark, hot):
    from reviewloom.operators import scoring
    rows = cleaning.preprocess(hot)
    scored = scoring.score_model(rows, scoring.fit_sentiment_model(rows), key="review_id")
    assert "size(filter(" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_batch_scores_the_stored_rows_as_they_are(spark, hot, tmp_path, monkeypatch):
    from reviewloom.operators import scoring
    from reviewloom.plans import batch
    paths = batch.BatchPaths(str(tmp_path / "b"))
    batch.clean_stage(hot, paths)
    fresh = scoring.fresh_path
    monkeypatch.setattr(scoring, "fresh_path", lambda spark, name: pytest.fail("stored again") if name == "to-score" else fresh(spark, name))
    scored = batch.sentiment_stage(spark, paths)
    assert scored.count() == 3000 and "row_key" not in scored.columns
