from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reviewloom import vocab
from reviewloom.plans.analyze import analyze
from reviewloom.schema import ColumnMapping
from reviewloom.sources import reviews_csv, stages, workspace
from reviewloom.sources.reviews_csv import load_reviews, read_csv
from reviewloom.sources.sample import SAMPLE_ROWS
from reviewloom.sources.store import ReviewStore


def write(tmp_path, text):
    path = tmp_path / "reviews.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, 'review_text,rating,extra\n"two\nlines, ""quoted""",4,x\nplain,,y\n')
    rows = sorted(tuple(r) for r in load_reviews(spark, path, ColumnMapping(rating="rating")).collect())
    assert rows == [("plain", None, "y"), ('two\nlines, "quoted"', 4.0, "x")]


def test_csv_null_spellings_are_exact(spark, tmp_path):
    cells = [c for c in vocab.CSV_NULLS if c]
    path = write(tmp_path, "review_text,n\n" + "".join(f'"{c}",1\n' for c in cells) + '" NA ",1\nN/A!,1\n"  ",1\n')
    assert sorted(r["review_text"] for r in load_reviews(spark, path).collect()) == ["N/A!", "NA"]
    assert read_csv(spark, path).where("review_text is null").count() == len(cells)


def test_missing_text_column(spark, tmp_path):
    with pytest.raises(KeyError):
        load_reviews(spark, write(tmp_path, "other\nhello\n"))


def test_missing_file_gives_the_sample(spark, tmp_path):
    assert load_reviews(spark, str(tmp_path / "none.csv")).count() == len(SAMPLE_ROWS)


def test_mapping_renames_and_keeps_the_rest(spark):
    df = spark.createDataFrame([("t", "5", "d", 1)], "Body string, Stars string, When string, n int")
    assert ColumnMapping("Body", "Stars", "When").apply(df).columns == ["review_text", "rating", "review_date", "n"]
    assert ColumnMapping("Body").apply(df).columns == ["review_text", "Stars", "When", "n"]


@pytest.fixture
def store(spark, tmp_path):
    return ReviewStore(spark, str(tmp_path / "store"))


def test_store_round_trip(store, reviews):
    analyzed = analyze(reviews)
    store.save_analysis(analyzed, "first")
    loaded, expected = store.load_analysis("first").collect(), analyzed.orderBy("review_id").collect()
    for name in ("review_id", "review_text", "clean_deep", "sentiment", "confidence", "aspects", "rating", "review_date"):
        assert [r[name] for r in loaded] == [r[name] for r in expected]
    pairs = {(r["review_id"], r["aspect"]) for r in store.aspects("first").collect()}
    assert pairs == {(r["review_id"], a) for r in expected for a in r["aspects"]}


def test_saving_again_replaces(store, reviews):
    analyzed = analyze(reviews)
    store.save_analysis(analyzed, "first")
    store.save_analysis(analyzed, "second")
    before = store.aspects("first").count()
    store.save_analysis(analyzed, "first")
    assert (store.reviews("first").count(), store.aspects("first").count(), store.reviews().count()) == (7, before, 14)
    store.save_analysis(analyzed.withColumn("aspects", F.array().cast("array<string>")), "first")
    assert store.aspects("first").count() == 0 and store.aspects("second").count() == before


def test_store_makes_ids_and_takes_dataset_columns(store, reviews):
    many = analyze(reviews.drop("review_id", "rating", "review_date")).withColumn("dataset_id", F.when(F.length("review_text") > 30, "long").otherwise("12"))
    store.save_analysis(many)
    assert [r["dataset_id"] for r in store.list_datasets().collect()] == ["12", "long"]
    ids = [r["review_id"] for r in store.reviews().collect()]
    assert len(set(ids)) == len(ids) == 7
    joined = store.aspects().join(store.reviews().select("dataset_id", "review_id"), ["dataset_id", "review_id"])
    assert joined.count() == store.aspects().count() > 0


def test_empty_store(store):
    assert not store.dataset_exists("x") and store.load_strategy("x") is None and store.list_datasets().count() == 0


def test_existence(store, reviews):
    store.save_analysis(analyze(reviews), "here")
    assert store.dataset_exists("here") and not store.dataset_exists("there")


def test_strategies_upsert(spark, store):
    def save(*rows):
        store.save_strategies(spark.createDataFrame(list(rows), "dataset_id string, strategy_json string"))
    save(("a", "{}"), ("b", "[1]"))
    save(("a", '{"x": 1}'))
    assert (store.load_strategy("a"), store.load_strategy("b"), store.load_strategy("c")) == ('{"x": 1}', "[1]", None)
    assert store.strategies().where("created_at is null").count() == 0 and store.strategies().count() == 2


def test_latest_strategy_of_a_batch_wins(spark, store):
    rows = [("a", str(i), f"2026-01-01 00:00:{i:02d}") for i in range(50)]
    df = spark.createDataFrame(rows, "dataset_id string, strategy_json string, at string")
    store.save_strategies(df.select("dataset_id", "strategy_json", F.col("at").cast("timestamp").alias("created_at")))
    assert store.load_strategy("a") == "49"


def test_stage_and_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"])], "n int, v array<string>")
    assert stages.write_stage(df, str(tmp_path / "s")).collect() == df.collect()
    stages.write_documents(df, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).first()[0] == '{"n":1,"v":["a"]}'


def test_shared_folder_is_the_named_one(spark):
    assert workspace.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert workspace.fresh_path(spark, "x") != workspace.fresh_path(spark, "x")


def test_uploads_with_odd_values_are_stored(spark, tmp_path):
    from reviewloom.sources.store import ReviewStore
    store = ReviewStore(spark, str(tmp_path))
    rows = [("a-17", "fine", "5 stars", "positive", 0.5, ["price"]), ("a-18", "bad", "1", "negative", 0.5, [])]
    store.save_analysis(spark.createDataFrame(rows, "review_id string, review_text string, rating string, sentiment string, confidence double, aspects array<string>"), "up")
    got = {r.source_id: r for r in store.reviews("up").collect()}
    assert (got["a-17"].rating, got["a-18"].rating) == (None, 1.0) and got["a-17"].review_id != got["a-18"].review_id
    assert [r.review_id for r in store.aspects("up").collect()] == [got["a-17"].review_id]


def test_clashing_column_names_are_refused(spark):
    import pytest
    from reviewloom.schema import ColumnMapping
    df = spark.createDataFrame([("x", "1", "2")], "review_text string, Stars string, rating string")
    with pytest.raises(ValueError):
        ColumnMapping(rating="Stars").apply(df)
    with pytest.raises(ValueError):
        ColumnMapping("Stars", "Stars").apply(df)


def test_both_tables_or_neither(store, reviews, monkeypatch):
    """A run that ends between its two tables leaves what was there, in both."""
    analyzed = analyze(reviews)
    store.save_analysis(analyzed, "first")
    before = (sorted(store.reviews("first").collect()), sorted(store.aspects("first").collect()))
    write = store._write

    def broken(df, table, path):
        if table == "review_aspects":
            raise OSError("lost")
        write(df, table, path)
    monkeypatch.setattr(store, "_write", broken)
    for name in ("first", "second"):
        with pytest.raises(OSError):
            store.save_analysis(analyzed.withColumn("sentiment", F.lit("neutral")), name)
    assert (sorted(store.reviews("first").collect()), sorted(store.aspects("first").collect())) == before
    assert [r[0] for r in store.list_datasets().collect()] == ["first"] and not store.dataset_exists("second")
    monkeypatch.setattr(store, "_write", write)
    store.save_analysis(analyzed.withColumn("sentiment", F.lit("neutral")), "first")
    assert {r.sentiment for r in store.reviews("first").collect()} == {r.sentiment for r in store.aspects("first").collect()} == {"neutral"}
    assert store.remove_replaced() == 1 and store.remove_replaced() == 0
    assert store.reviews("first").count() == 7 and store.reviews().count() == 7


def test_datasets_are_listed_without_reading_them(store, reviews):
    names = ["a b", "x=1/y", "100%", "ü'\"", None]
    for name in names:
        store.save_analysis(analyze(reviews).withColumn("dataset_id", F.lit(name).cast("string")))
    listed = store.list_datasets()
    assert [r[0] for r in listed.collect()] == [None, *sorted(n for n in names if n)]
    assert "Scan parquet" not in listed._jdf.queryExecution().executedPlan().toString()
    assert all(store.dataset_exists(n) and store.reviews(n).count() == 7 for n in names if n) and not store.dataset_exists("100")
    assert store.reviews().where("dataset_id IS NULL").count() == 7


def test_line_ids_follow_files_and_lines(spark, tmp_path):
    lines = [f"text {i}" for i in range(3000)]
    for part in range(3):
        body = "review_text,n\n" + "".join(f"{t},{i}\n" for i, t in enumerate(lines) if i // 1000 == part)
        (tmp_path / f"part-{part}.csv").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "7000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = load_reviews(spark, str(tmp_path), line_ids="line")
            assert df.columns == ["review_text", "n", "line"]
            assert {(r.line, int(r.n), r.review_text) for r in df.collect()} == {(i, i, t) for i, t in enumerate(lines)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_are_split_unless_fields_span_lines(spark, tmp_path):
    path = write(tmp_path, 'review_text,n\n"two\nlines",1\nplain,2\n')
    assert reviews_csv.fields_span_lines(spark, path)
    assert not reviews_csv.fields_span_lines(spark, write(tmp_path, 'review_text,n\n"a ""b"" c",1\n'))
    path = write(tmp_path, 'review_text,n\n"two\nlines",1\nplain,2\n')
    assert sorted(r.review_text for r in load_reviews(spark, path, multi_line=True).collect()) == ["plain", "two\nlines"]
    assert [r.line for r in load_reviews(spark, path, multi_line=True, line_ids="line").orderBy("n").collect()] == [0, 1]


def test_staged_paths_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(workspace, "_made", {})
    path = workspace.fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert workspace.path_exists(spark, path) and workspace.remove_staged(spark) == 1
    assert not workspace.path_exists(spark, path) and workspace.remove_staged(spark) == 0


def test_records_are_not_shuffled_for_their_line_ids(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(100).selectExpr("id AS n", "concat('text ', id) AS review_text").repartition(4).write.option("header", True).csv(path)
    plan = load_reviews(spark, path, line_ids="line")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_texts_that_repeat_each_other_are_stored_once(spark, tmp_path):
    import random
    draw = random.Random(3)
    rows = []
    for i in range(400):
        text = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(2000))
        rows.append((text, i, text.upper() if i % 50 == 0 else text[3:], None if i % 7 == 0 else text))
    df = spark.createDataFrame(rows, "review_text string, i long, clean_light string, clean_deep string").coalesce(1)
    size = lambda path: sum(f.stat().st_size for f in path.glob("*.parquet"))
    stored = stages.write_stage(df, str(tmp_path / "t"), ("review_text", "clean_light", "none", "clean_deep"))
    assert stored.schema.names == df.columns and sorted(stored.collect()) == sorted(df.collect())
    stages.write_stage(df, str(tmp_path / "each"))
    assert size(tmp_path / "t") < 0.5 * size(tmp_path / "each")
    assert stages.write_stage(df.select("i", "review_text"), str(tmp_path / "one"), ("review_text", "clean_deep")).columns == ["i", "review_text"]


def test_shuffle_files_are_removed(spark):
    before = spark.conf.get(workspace.SHUFFLE_CLEANUP, None)
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    kept = shuffles()
    with workspace.shuffles_removed(spark):
        assert len(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().collect()) == 10
    assert shuffles() <= kept and spark.conf.get(workspace.SHUFFLE_CLEANUP, None) == before
