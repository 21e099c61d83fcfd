from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[*]").appName("reviewloom-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def reviews(spark):
    """Small reviews that touch every aspect."""
    rows = [
        (1, "Delivery was quick and the courier friendly.", 5.0, "2026-03-01"),
        (2, "The staff were rude, I want a refund!", 1.0, "2026-03-01"),
        (3, "Good value for the price.", 4.0, "2026-03-02"),
        (4, "Terrible app, the checkout is confusing.", 2.0, "2026-03-02"),
        (5, "The box arrived crushed, awful packaging.", 1.0, None),
        (6, "Durable material, excellent quality.", 5.0, "03/04/2026"),
        (7, "It is blue.", 3.0, "soon"),
    ]
    return spark.createDataFrame(rows, "review_id long, review_text string, rating double, review_date string")


def column(df, name, key=None):
    """Values of one column, ordered by `key` if given."""
    ordered = df.orderBy(key) if key else df
    return [r[name] for r in ordered.collect()]
