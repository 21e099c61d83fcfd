"""Review tables derived from the given tables. `oracle.py` states the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.plans.analyze import analyze
from reviewloom.sources.store import ReviewStore
from reviewloom.sources.workspace import fresh_path, path_exists, read_table

# The documents are invented prose without any aspect keyword; each gets one of these sentences in front.
PHRASES = [
    ("The courier was late and tracking never worked, awful!", 1),
    ("Arrive date was perfect, delivery is excellent.", 5),
    ("Expensive, but worth the money.", 4),
    ("Price is fine.", 3),
    ("Broken on day one, terrible material!!!", 1),
    ("Durable build and GREAT quality.", 5),
    ("Staff were rude and the refund is not good.", 2),
    ("Support gave a helpful response, love it.", 5),
    ("The box and seal were crushed.", 2),
    ("Package wrap was okay.", 3),
    ("Checkout interface is confusing, see https://example.com/help now", 2),
    ("<b>Easy</b> app, nice website!", 5),
    ("Blue, medium size, worshipped by trackers.", 3),
    ("Worth every cent: amazing value and easy delivery!", 5),
    ("Not bad at all.", 4),
    ("Cheap seal, broken box, rude staff, late delivery, confusing app. HATE it.", 1),
]


tasks: int | None = None  # set by the bench: the given tables hold one row group each, which one task would read alone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", tasks)


def _pick(values: list, key: Column) -> Column:
    return F.element_at(F.lit(values), (key % len(values) + 1).cast("int"))


def _rating(key: Column) -> Column:
    base = _pick([float(r) for _, r in PHRASES], key)
    return F.when(key % 11 == 0, None).when(key % 7 == 0, (1 + key % 5).cast("double")).otherwise(base)


def reviews(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """One review per document: long texts in four languages, four datasets. `extra` columns pass through."""
    key = F.col("doc_id")
    date = F.date_add(F.lit("2026-01-01").cast("date"), (key % 60).cast("int")).cast("string")
    return table(spark, sf_dir, "documents").select(
        key.alias("review_id"), F.concat(F.lit("docs_"), "lang").alias("dataset_id"),
        F.concat(_pick([p for p, _ in PHRASES], key), F.lit(" "), "text").alias("review_text"),
        _rating(key).alias("rating"),
        F.when(key % 13 == 0, None).when(key % 17 == 0, "not a date").otherwise(date).alias("review_date"), *extra)


def reviews_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short review per order: many rows, five datasets."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("review_id"), F.col("o_orderpriority").alias("dataset_id"),
        _pick([p for p, _ in PHRASES], key).alias("review_text"), _rating(key).alias("rating"),
        F.when(key % 13 == 0, None).otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("review_date"))


_stores: dict[tuple[str, str], ReviewStore] = {}


def stored_reviews(spark: SparkSession, sf_dir: str) -> ReviewStore:
    """The reviews of both views, analysed and saved once per session: the tables that later questions read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    store = _stores.get(key)
    if store is None or not path_exists(spark, store.table_path("review_aspects")):
        store = ReviewStore(spark, fresh_path(spark, "store"))
        store.save_analysis(analyze(reviews(spark, sf_dir).unionByName(reviews_scale(spark, sf_dir))))
        _stores[key] = store
    return store
