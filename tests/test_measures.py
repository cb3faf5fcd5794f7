from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from starward.functions import measures as m


def decimals(spark, values):
    rows = [(i, None if v is None else Decimal(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i int, x decimal(20,10)").orderBy("i")


def mapped(spark, values, expression):
    return [r[0] for r in decimals(spark, values).select(expression(F.col("x"))).collect()]


def test_spending_levels_include_both_bounds_in_the_middle(spark):
    low, average, high = m.SPENDING_LEVELS
    values = ["0.9499", "0.95", "1.05", "1.0501"]
    assert mapped(spark, values, m.spending_level) == [low, average, average, high]


def test_infection_ranges(spark):
    labels = mapped(spark, ["0", "0.49", "0.5", "1.0", "1.5", "2.0"], m.infection_range)
    assert [label[0] for label in labels] == list("123456")


def test_infection_measure_pattern_escapes_underscores(spark):
    df = spark.createDataFrame([("HAI_1_SIR",), ("HAI_1_CILOWER",), ("HAIx1xSIR",)], "id string")
    matched = df.where(F.col("id").like(m.INFECTION_RATIO)).collect()
    assert [r.id for r in matched] == ["HAI_1_SIR"]


def test_rounding_is_half_away_from_zero(spark):
    values = ["0.285", "-0.1925", "2.5"]
    assert mapped(spark, values, lambda c: m.rounded(c, 2)) == [0.29, -0.19, 2.5]
    assert mapped(spark, values, lambda c: m.rounded(c, 3))[1] == -0.193
    assert mapped(spark, ["0.285"], lambda c: m.rounded_float(c.cast("double"), 2)) == [0.29]


def test_percent_of_nothing_is_null(spark):
    df = decimals(spark, ["1", "2", "3"])
    whole, none = df.agg(
        m.percent(m.rows_where(F.col("x") > 1), m.rows(), 1), m.percent(m.rows(), F.lit(0), 1)
    ).first()
    assert (whole, none) == (66.7, None)


def test_correlation_of_constant_or_single_row_is_null(spark):
    def corr(pairs):
        df = spark.createDataFrame(pairs, "x double, y double")
        return df.agg(m.correlation(F.col("x"), F.col("y"), 3)).first()[0]

    assert corr([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)]) is None
    assert corr([(1.0, 2.0)]) is None
    assert corr([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]) == 1.0


def test_every_state_has_one_region(spark):
    states = [s for names in m.CENSUS_REGIONS.values() for s in names]
    assert len(states) == len(set(states)) == 51
    df = spark.createDataFrame([("CT",), ("OH",), ("DC",), ("HI",), ("PR",)], "state string")
    regions = [r[0] for r in df.select(m.census_region(F.col("state"))).collect()]
    assert regions == ["Northeast", "Midwest", "South", "West", "Territories"]


def test_ownership_groups(spark):
    names = ["Proprietary", "Physician", "Voluntary non-profit - Church", "Tribal", None]
    df = spark.createDataFrame([(n,) for n in names], "o string")
    groups = [r[0] for r in df.select(m.ownership_group(F.col("o"))).collect()]
    assert groups == ["For-profit", "For-profit", "Non-profit", "Government", "Government"]


def test_labels(spark):
    df = spark.createDataFrame([(3,), (None,)], "r int")
    label, fallback = m.star_label(F.col("r")), m.star_label_or_unrated(F.col("r"))
    assert [tuple(r) for r in df.select(label, fallback).collect()] == [
        ("3 stars", "3 stars"),
        (None, "Not rated"),
    ]
