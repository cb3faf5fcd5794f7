from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from starward.functions import cleaning as clean


def apply(spark, values, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_ids_are_padded_and_long_ids_reported(spark):
    ids = ["10001", "010001", "1234567"]
    assert apply(spark, ids, clean.pad_id) == ["010001", "010001", "1234567"]
    assert apply(spark, ids, clean.id_rejected) == [False, False, True]


def test_blank_and_unavailable_become_null(spark):
    values = ["a", "", "Not Available", None]
    assert apply(spark, values, clean.blank_to_null) == ["a", None, "Not Available", None]
    assert apply(spark, values, clean.unavailable_to_null) == ["a", None, None, None]


def test_numbers(spark):
    values = ["1.5", "-0.5", "5.", "-.5", "Not Available", "--", "", None, "12\n", " 1"]
    expected = [Decimal(x) for x in ("1.5", "-0.5", "5", "-0.5")] + [None] * 6
    assert apply(spark, values, clean.to_number) == expected


@pytest.mark.parametrize("text", ["1.2.3", ".", "123456789012", "0.12345678901"])
def test_text_that_only_looks_numeric(spark, text):
    with pytest.raises(Exception, match="not a valid number"):
        apply(spark, [text], clean.to_number)
    assert apply(spark, [text], lambda c: clean.to_number(c, strict=False)) == [None]
    assert apply(spark, [text], clean.number_rejected) == [True]


def test_strict_errors_do_not_need_ansi(spark, conf):
    conf("spark.sql.ansi.enabled", "false")
    with pytest.raises(Exception, match="not a valid number"):
        apply(spark, ["1.2.3"], clean.to_number)


def test_counts(spark):
    values = ["1,204", "0", "-3", "", None, "Not Applicable"]
    assert apply(spark, values, clean.to_count) == [1204, 0, None, None, None, None]
    with pytest.raises(Exception, match="not a valid count"):
        apply(spark, ["99999999999"], clean.to_count)
    assert apply(spark, ["99999999999"], lambda c: clean.to_count(c, strict=False)) == [None]
    assert apply(spark, ["99999999999", "-3", "7"], clean.count_rejected) == [True, True, False]


def test_stars(spark):
    values = ["1", "2", "3", "4", "5", "0", "6", "Not Applicable", None]
    assert apply(spark, values, clean.to_stars) == [1, 2, 3, 4, 5, None, None, None, None]


def test_flags(spark):
    values = ["Yes", "No", "", None]
    assert apply(spark, values, clean.yes_no) == [True, False, None, None]
    assert apply(spark, ["Y", "", None], clean.flag_y) == [True, False, False]


def test_dates(spark):
    day = datetime.date(2024, 7, 1)
    values = ["07/01/2024", "7/1/2024", "2024-07-01", "", None]
    assert apply(spark, values, clean.to_date) == [day, day, day, None, None]
    with pytest.raises(Exception, match="not a valid date"):
        apply(spark, ["13/45/2024"], clean.to_date)
    assert apply(spark, ["13/45/2024"], lambda c: clean.to_date(c, strict=False)) == [None]
    assert apply(spark, ["13/45/2024", "7/1/2024"], clean.date_rejected) == [True, False]
