"""Raw text tables to dimensions and facts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starward.functions import cleaning as clean
from starward.operators.joins import BROADCAST_BYTES, HOT_SHARE, join_lookup, measured_bytes
from starward.operators.ordering import global_row_number
from starward.sources.schemas import star_schema
from starward.sources.shared import write_shared

# Source of each measure domain, in the columns that name its measures.
MEASURE_DOMAINS = [
    ("complications", "Complications & Deaths", "measure_id", "measure_name", None),
    ("infections", "Infections", "measure_id", "measure_name", None),
    ("unplanned_visits", "Unplanned Visits", "measure_id", "measure_name", None),
    (
        "patient_survey",
        "Patient Experience",
        "hcahps_measure_id",
        "hcahps_question",
        "hcahps_answer_description",
    ),
    ("spending", "Spending", "measure_id", "measure_name", None),
]


def _typed(df: DataFrame, table: str) -> DataFrame:
    """The declared columns in the declared order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in star_schema(table)])


def dim_hospital(raw: DataFrame) -> DataFrame:
    cleaned = {
        "facility_id": clean.pad_id(F.col("facility_id")),
        **{
            name: clean.blank_to_null(F.col(name))
            for name in "address city_town zip_code county_parish telephone_number".split()
        },
        "emergency_services": clean.yes_no(F.col("emergency_services")),
        "birthing_friendly": clean.flag_y(F.col("meets_birthing_friendly")),
        "overall_rating": clean.to_stars(F.col("hospital_overall_rating")),
    }
    return _typed(raw.withColumns(cleaned), "dim_hospital")


def dim_measure(raws: Mapping[str, DataFrame]) -> DataFrame:
    """One row per measure and source; MIN over text is by bytes."""
    parts = []
    for source, domain, measure, name, detail in MEASURE_DOMAINS:
        parts.append(
            raws[source]
            .groupBy(F.col(measure).alias("measure_id"))
            .agg(
                F.min(name).alias("measure_name"),
                (F.min(detail) if detail else F.lit(None)).cast("string").alias("measure_detail"),
            )
            .withColumn("measure_domain", F.lit(domain))
        )
    return _typed(reduce(DataFrame.unionByName, parts), "dim_measure")


def dim_period(raws: Mapping[str, DataFrame], strict: bool = True) -> DataFrame:
    """Distinct date ranges of the five measure sources, numbered in date order."""
    texts = [
        raws[source]
        .where((F.col("start_date") != "") & (F.col("end_date") != ""))
        .select("start_date", "end_date")
        .distinct()
        for source, *_ in MEASURE_DOMAINS
    ]
    periods = (
        reduce(DataFrame.union, texts)
        .select(*[clean.to_date(F.col(c), strict).alias(c) for c in ("start_date", "end_date")])
        .dropna()
        .distinct()
    )
    return _typed(global_row_number(periods, ["start_date", "end_date"], "period_id"), "dim_period")


def _drop_unknown(rows: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Rows of unknown hospitals go before any shuffle, however often an unknown id occurs.

    Distinct ids, with their counts, are compared first. The unknown ones are broadcast if they
    are small. If not, only those that hold more than 1/HOT_SHARE of the rows are, of which there
    are fewer than HOT_SHARE; the rest is even enough for the join with the hospitals.
    """
    ids = rows.groupBy("facility_id").agg(F.count(F.lit(1)).alias("n"))
    unknown = ids.where(F.col("facility_id").isNotNull()).join(hospitals, "facility_id", "left_anti")
    unknown = write_shared(unknown, "unknown-ids")
    if measured_bytes(unknown) > BROADCAST_BYTES:
        total = rows.count()
        unknown = unknown.where(F.col("n") * HOT_SHARE > total)
    return rows.join(F.broadcast(unknown.select("facility_id")), "facility_id", "left_anti")


def _fact(
    raw: DataFrame,
    table: str,
    columns: Mapping[str, Column],
    hospitals: DataFrame,
    periods: DataFrame,
    strict: bool,
    measure: str = "measure_id",
) -> DataFrame:
    """Keep rows of known hospitals, then clean the value columns and look up the period.

    In this order, unusable text of an unknown hospital stops nothing. Only the join keys of
    the dimensions take part. A row without dates has no period.
    """
    padded = raw.withColumn("facility_id", clean.pad_id(F.col("facility_id")))
    ids = hospitals.select("facility_id")
    known = _drop_unknown(padded, ids).join(ids, "facility_id", "left_semi")
    cleaned = known.select(
        "facility_id",
        F.col(measure).alias("measure_id"),
        *[clean.to_date(F.col(c), strict).alias(c) for c in ("start_date", "end_date")],
        *[c.alias(name) for name, c in columns.items()],
    )
    return _typed(join_lookup(cleaned, periods, ["start_date", "end_date"], "left"), table)


def _numbers(names: str, strict: bool) -> dict[str, Column]:
    return {name: clean.to_number(F.col(name), strict) for name in names.split()}


def _counts(names: str, strict: bool) -> dict[str, Column]:
    return {name: clean.to_count(F.col(name), strict) for name in names.split()}


def fact_complications_deaths(
    raw: DataFrame, hospitals: DataFrame, periods: DataFrame, strict: bool = True
) -> DataFrame:
    columns = {
        "compared_to_national": clean.unavailable_to_null(F.col("compared_to_national")),
        **_numbers("denominator score lower_estimate higher_estimate", strict),
        "footnote": clean.blank_to_null(F.col("footnote")),
    }
    return _fact(raw, "fact_complications_deaths", columns, hospitals, periods, strict)


def fact_infections(
    raw: DataFrame, hospitals: DataFrame, periods: DataFrame, strict: bool = True
) -> DataFrame:
    columns = {
        "compared_to_national": clean.unavailable_to_null(F.col("compared_to_national")),
        **_numbers("score", strict),
        "footnote": clean.blank_to_null(F.col("footnote")),
    }
    return _fact(raw, "fact_infections", columns, hospitals, periods, strict)


def fact_unplanned_visits(
    raw: DataFrame, hospitals: DataFrame, periods: DataFrame, strict: bool = True
) -> DataFrame:
    columns = {
        "compared_to_national": clean.unavailable_to_null(F.col("compared_to_national")),
        **_numbers("denominator score lower_estimate higher_estimate", strict),
        **_counts("number_of_patients number_of_patients_returned", strict),
        "footnote": clean.blank_to_null(F.col("footnote")),
    }
    return _fact(raw, "fact_unplanned_visits", columns, hospitals, periods, strict)


def fact_patient_survey(
    raw: DataFrame, hospitals: DataFrame, periods: DataFrame, strict: bool = True
) -> DataFrame:
    columns = {
        "star_rating": clean.to_stars(F.col("patient_survey_star_rating")),
        "answer_percent": clean.to_number(F.col("hcahps_answer_percent"), strict),
        "linear_mean_value": clean.to_number(F.col("hcahps_linear_mean_value"), strict),
        "completed_surveys": clean.to_count(F.col("number_of_completed_surveys"), strict),
        "response_rate_percent": clean.to_number(F.col("survey_response_rate_percent"), strict),
    }
    return _fact(
        raw, "fact_patient_survey", columns, hospitals, periods, strict, "hcahps_measure_id"
    )


def fact_spending(
    raw: DataFrame, hospitals: DataFrame, periods: DataFrame, strict: bool = True
) -> DataFrame:
    columns = {
        "mspb_ratio": clean.to_number(F.col("score"), strict),
        "footnote": clean.blank_to_null(F.col("footnote")),
    }
    return _fact(raw, "fact_spending", columns, hospitals, periods, strict)


FACT_BUILDERS = {
    "fact_complications_deaths": fact_complications_deaths,
    "fact_infections": fact_infections,
    "fact_unplanned_visits": fact_unplanned_visits,
    "fact_patient_survey": fact_patient_survey,
    "fact_spending": fact_spending,
}
