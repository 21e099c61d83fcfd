"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from suite import oracle, queries
from suite.compare import compare, connect
from tests.conftest import SMALL

ROWS_ONLY = {"topic_assign", "topic_assign_text"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SMALL, name) == ""


def test_all_but_a_few_have_sql():
    assert set(queries.QUERIES) - set(oracle.oracle_sql()) == ROWS_ONLY
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(queries.QUERIES) <= set(entry_points.queries())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["dataset_id", "aspect", "total", "positive", "neutral", "negative"]
    assert {r["aspect"] for r in df.collect()} == {"delivery", "price", "quality", "support", "packaging", "ux"}
