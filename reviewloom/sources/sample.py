"""A handful of reviews that touch every aspect, for a first try without data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLE_ROWS = [
    ("The parcel turned up two days late and the courier never rang.", 2.0, "2026-02-01"),
    ("Fair price and very good value, I would buy it again.", 5.0, "2026-02-02"),
    ("Sturdy material, the build is excellent!", 5.0, "2026-02-02"),
    ("Staff were rude and my refund is still missing.", 1.0, "2026-02-04"),
    ("The box was crushed and the seal broken.", 2.0, "2026-02-05"),
    ("Checkout in the app is confusing on a phone.", 2.0, "2026-02-06"),
    ("Fine so far, nothing remarkable.", 3.0, "2026-02-07"),
    ("Cheap, but it works and delivery was quick.", 4.0, "2026-02-09"),
]


def sample_reviews(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_ROWS, "review_text string, rating double, review_date string")
