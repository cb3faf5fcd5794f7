"""Every catalogue entry against DuckDB on the sample tables."""

from __future__ import annotations

import compare
import pytest
from conftest import SAMPLES

import __spark_entry__ as entry_points
from starward.plans import catalogue

QUERIES = {name: entry_points.queries()[name] for name in catalogue.QUESTIONS}
EXPECTED = entry_points.oracle_sql()
FOLDER = str(SAMPLES / "sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = compare.connect(FOLDER)
    yield con
    con.close()


def test_every_query_has_an_expected_result():
    assert QUERIES.keys() <= EXPECTED.keys() <= entry_points.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_same_result(spark, duck, name):
    columns, rows = compare.spark_rows(QUERIES[name](spark, FOLDER))
    expected_columns, expected_rows = compare.duck_rows(duck, EXPECTED[name])
    assert columns == expected_columns
    assert rows == expected_rows
    assert rows


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns[0] == "spending_quartile"
    assert df.count() == 4
