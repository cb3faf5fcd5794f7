"""Expressions shared by the queries: rounding, shares, labels, groupings."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from starward.functions.cleaning import NUMBER

# Measure ids and labels that appear in results or select rows.
SPENDING = "MSPB-1"
HF_READMISSION = "READM_30_HF"
HF_DEATH = "MORT_30_HF"
SAFETY_INDEX = "PSI_90"
SURVEY_STARS = "H_STAR_RATING"
RECOMMEND = "H_RECMND_DY"
INFECTION_RATIO = r"HAI\__\_SIR"
ACUTE_CARE = "Acute Care Hospitals"
FOR_PROFIT = ["Proprietary", "Physician"]
NON_PROFIT = "Voluntary non-profit"
SPENDING_LEVELS = ["1. Low (below 0.95)", "2. Average (0.95 to 1.05)", "3. High (above 1.05)"]
VALUE_GROUPS = [
    "1. High quality, low cost",
    "2. High quality, high cost",
    "3. Lower quality, low cost",
    "4. Lower quality, high cost",
]
INFECTION_RANGES = [
    ("0.5", "2. Above 0 to 0.49"),
    ("1.0", "3. 0.50 to 0.99"),
    ("1.5", "4. 1.00 to 1.49"),
    ("2.0", "5. 1.50 to 1.99"),
]
NO_INFECTIONS = "1. 0 (no infections)"
MOST_INFECTIONS = "6. 2.00 or higher"
# Census Bureau regions, states in the Bureau's division order.
CENSUS_REGIONS = {
    "Northeast": ["CT", "ME", "MA", "NH", "RI", "VT", "NJ", "NY", "PA"],
    "Midwest": ["IL", "IN", "MI", "OH", "WI", "IA", "KS", "MN", "MO", "NE", "ND", "SD"],
    "South": ["DE", "DC", "FL", "GA", "MD", "NC", "SC", "VA", "WV", "AL", "KY", "MS", "TN", "AR", "LA", "OK", "TX"],
    "West": ["AZ", "CO", "ID", "MT", "NV", "NM", "UT", "WY", "AK", "CA", "HI", "OR", "WA"],
}


def ratio() -> Column:
    return F.col("mspb_ratio")


def rating() -> Column:
    """The overall stars as results show them."""
    return F.col("overall_rating").cast("int").alias("overall_rating")


def number(text: str) -> Column:
    """An exact decimal literal."""
    return F.lit(Decimal(text))


def exact(c: Column) -> Column:
    """The decimal every average is taken over, so that averages are exact."""
    return c.cast(NUMBER)


def rounded(c: Column, digits: int) -> Column:
    """Round half away from zero on decimals; the result is a double."""
    return F.round(c, digits).cast("double")


def rounded_float(c: Column, digits: int) -> Column:
    """Same for a double: to decimal first, so 0.285 is a tie and not 0.28499..."""
    return rounded(c.cast(NUMBER), digits)


def mean(c: Column, digits: int) -> Column:
    return rounded(F.avg(exact(c)), digits)


def spread(c: Column, digits: int) -> Column:
    """Sample standard deviation; NULL for a single row."""
    return rounded_float(F.stddev_samp(c), digits)


def rows() -> Column:
    return F.count(F.lit(1))


def rows_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``100 * part / whole`` of two counts.

    decimal(18,0) operands leave the quotient 16 decimals; wider ones would leave 6.
    """
    quotient = F.try_divide(F.lit(100) * part.cast("decimal(18,0)"), whole.cast("decimal(18,0)"))
    return rounded(quotient, digits)


def correlation(x: Column, y: Column, digits: int) -> Column:
    """Pearson correlation; NULL, not an error, when a series is constant."""
    x, y = x.cast("double"), y.cast("double")
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    return rounded_float(r, digits)


def spending_level(ratio: Column) -> Column:
    low, average, high = SPENDING_LEVELS
    return (
        F.when(ratio < number("0.95"), low).when(ratio <= number("1.05"), average).otherwise(high)
    )


def infection_range(ratio: Column) -> Column:
    label = F.when(ratio == 0, NO_INFECTIONS)
    for bound, text in INFECTION_RANGES:
        label = label.when(ratio < number(bound), text)
    return label.otherwise(MOST_INFECTIONS)


def value_group(rating: Column, ratio: Column) -> Column:
    """Needs both inputs: a NULL would fall through to a wrong group."""
    good, cheap = rating >= 4, ratio <= 1
    both, dear, poor, neither = VALUE_GROUPS
    return F.when(good & cheap, both).when(good, dear).when(cheap, poor).otherwise(neither)


def census_region(state: Column) -> Column:
    region = F.lit(None).cast("string")
    for name, states in CENSUS_REGIONS.items():
        region = F.when(state.isin(states), name).otherwise(region)
    return F.coalesce(region, F.lit("Territories"))


def ownership_group(ownership: Column) -> Column:
    return (
        F.when(ownership.isin(FOR_PROFIT), "For-profit")
        .when(ownership.startswith(NON_PROFIT), "Non-profit")
        .otherwise("Government")
    )


def star_label(rating: Column) -> Column:
    """``'3 stars'``; NULL for an unrated hospital."""
    return F.concat(rating.cast("string"), F.lit(" stars"))


def star_label_or_unrated(rating: Column) -> Column:
    return F.coalesce(star_label(rating), F.lit("Not rated"))


def quartile_label(quartile: Column) -> Column:
    return F.concat(F.lit("Q"), quartile.cast("string"))
