from __future__ import annotations

import json

import pytest

from reviewloom.operators.profiling import guess_mapping
from reviewloom.plans.datasets import ingest, write_strategies
from reviewloom.schema import ColumnMapping
from reviewloom.sources.store import ReviewStore


@pytest.fixture
def store(spark, tmp_path):
    return ReviewStore(spark, str(tmp_path / "store"))


@pytest.fixture
def upload(spark):
    rows = [("The courier was late, awful!", "1", "2026-01-01"), ("Great price", "5", "2026-01-02"), ("Nice app", "4", None)]
    return spark.createDataFrame(rows, "`Customer Comment` string, Stars string, `Posted Date` string")


def test_columns_are_guessed(spark, upload):
    assert guess_mapping(upload) == ColumnMapping("Customer Comment", "Stars", "Posted Date")
    with pytest.raises(KeyError):
        guess_mapping(spark.range(1))


def test_the_same_upload_is_stored_once(store, upload):
    first = ingest(store, upload, "shop")
    assert first.startswith("shop_") and store.reviews(first).count() == 3
    assert ingest(store, upload.repartition(3), "shop") == first and store.reviews().count() == 3
    other = ingest(store, upload.limit(2), "shop")
    assert other != first and [r[0] for r in store.list_datasets().collect()] == sorted([first, other])
    row = store.reviews(first).where("rating = 1").first()
    assert (row["sentiment"], row["aspects"], row["review_date"]) == ("negative", ["delivery"], "2026-01-01")


def test_strategies_for_all_datasets(store, upload):
    good, bad = ingest(store, upload, "good"), ingest(store, upload, "bad")

    def load():
        def write(prompt):
            return "no idea" if '"bad_' in prompt else '```json\n{"executive_summary": "ok", "recommendations": []}\n```'
        return write
    write_strategies(store, load)
    assert json.loads(store.load_strategy(good)) == {"executive_summary": "ok", "recommendations": []}
    assert json.loads(store.load_strategy(bad)) == {"raw": "no idea"}
    write_strategies(store, lambda: lambda prompt: "[1]", bad)
    assert store.load_strategy(bad) == "[1]" and json.loads(store.load_strategy(good))["executive_summary"] == "ok"


def test_tables_can_be_declared_again_and_queried(spark, store, upload):
    store.create_tables()
    found = ingest(store, upload, "shop")
    store.create_tables()
    counts = spark.sql("SELECT dataset_id, count(*) AS n FROM default.analyzed_reviews GROUP BY dataset_id").collect()
    assert [tuple(r) for r in counts] == [(found, 3)]
    for table in ReviewStore.TABLES:
        spark.sql(f"DROP TABLE default.{table}")
    assert store.dataset_exists(found)


def test_prompts_are_asked_once(spark, store, upload, tmp_path):
    log = str(tmp_path / "asked")

    def load():
        def write(prompt):
            with open(log, "a") as asked:
                asked.write("x")
            return '{"executive_summary": "ok", "recommendations": []}'
        return write
    ingest(store, upload, "one")
    for _ in range(2):
        write_strategies(store, load, writer="w")
    assert open(log).read() == "x" and store.answers().count() == 1
    ingest(store, upload, "two")  # a new dataset has a new prompt; the old one is not asked again
    write_strategies(store, load, writer="w")
    assert open(log).read() == "xx" and store.strategies().count() == 2
    write_strategies(store, load, writer="another")
    assert open(log).read() == "xxxx"
