"""Raw text sources derived from the sample tables (customer, orders, lineitem, events).

The source files are not available offline. These views have their layout and their oddities:
ids with and without leading zeros, 'Not Available', '--', blanks, negative numbers, thousands
commas, blank dates, a second spending measure and one facility without a hospital row.
Amounts become whole cents before any sum, so no sum depends on the order of its rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starward.functions.cleaning import pad_id, zero_padded
from starward.sources.schemas import RAW_COLUMNS

# Fixed values of the sample data.
STATES = "CTMENYPANJILINMIOHWIFLGATXVANCTNAZCOCAWAORNVUTPRGU"
OWNERSHIPS = {
    "BUILDING": "Voluntary non-profit - Private",
    "FURNITURE": "Voluntary non-profit - Church",
    "MACHINERY": "Proprietary",
    "AUTOMOBILE": "Physician",
}
RATING_STEPS = [(2000, "1"), (4000, "2"), (6000, "3"), (8000, "4")]
COMPLICATION_MEASURES = {"1": "MORT_30_HF", "2": "MORT_30_AMI", "3": "MORT_30_PN", "4": "PSI_90"}
NATIONAL_RATE = [
    "Better Than the National Rate",
    "No Different Than the National Rate",
    "Worse Than the National Rate",
    "Not Available",
]
INFECTION_MEASURES = {
    "view": "HAI_1_SIR",
    "click": "HAI_2_SIR",
    "signup": "HAI_3_SIR",
    "purchase": "HAI_4_SIR",
}
NATIONAL_BENCHMARK = [
    "Better than the National Benchmark",
    "No Different than National Benchmark",
    "Worse than the National Benchmark",
]
VISIT_MEASURES = {
    "AF": "READM_30_HF",
    "AO": "READM_30_AMI",
    "NF": "READM_30_PN",
    "NO": "EDAC_30_HF",
    "RF": "OP_32",
}
SURVEY_MEASURES = {
    "1": ("H_STAR_RATING", "Summary star rating"),
    "2": ("H_COMP_1_STAR_RATING", "Nurse communication - star rating"),
    "3": ("H_COMP_2_STAR_RATING", "Doctor communication - star rating"),
    "4": ("H_RECMND_DY", "Would definitely recommend"),
}


def _text(c: Column) -> Column:
    return c.cast("string")


def _pick(c: Column, choices: Mapping, otherwise: str) -> Column:
    picked = None
    for value, result in choices.items():
        picked = F.when(c == value, result) if picked is None else picked.when(c == value, result)
    return picked.otherwise(otherwise)


def _hundredths(c: Column) -> Column:
    """Whole number of hundredths to text with two decimals."""
    scaled = c.cast("decimal(12,0)") * F.lit("0.01").cast("decimal(3,2)")
    return _text(scaled.cast("decimal(14,2)"))


def _cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("bigint")


def _layout(source: str, df: DataFrame) -> DataFrame:
    """All columns of the source in file order; the ones not given are blank."""
    return df.select(
        *[F.col(c) if c in df.columns else F.lit("").alias(c) for c in RAW_COLUMNS[source]]
    )


def _hospital_info(customer: DataFrame) -> DataFrame:
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    rating = F.when(balance < 0, "Not Available")
    for bound, stars in RATING_STEPS:
        rating = rating.when(balance < bound, stars)
    return customer.select(
        F.when(key % 3 == 0, _text(key)).otherwise(pad_id(_text(key))).alias("facility_id"),
        F.col("c_name").alias("facility_name"),
        F.concat(F.lit("City "), _text(key % 97)).alias("city_town"),
        F.substring(F.lit(STATES), F.col("c_nationkey") * 2 + 1, F.lit(2)).alias("state"),
        F.lpad(_text(key * 37 % 100000), 5, "0").alias("zip_code"),
        F.concat(F.lit("County "), _text(key % 53)).alias("county_parish"),
        F.when(key % 10 < 7, "Acute Care Hospitals")
        .when(key % 10 < 9, "Critical Access Hospitals")
        .otherwise("Psychiatric")
        .alias("hospital_type"),
        _pick(F.col("c_mktsegment"), OWNERSHIPS, "Government - State").alias("hospital_ownership"),
        _pick(key % 3, {0: "Yes", 1: "No"}, "").alias("emergency_services"),
        F.when(key % 5 == 0, "Y").otherwise("").alias("meets_birthing_friendly"),
        rating.otherwise("5").alias("hospital_overall_rating"),
    )


def _spending(orders: DataFrame) -> DataFrame:
    by_customer = orders.groupBy("o_custkey").agg(F.sum("cents").alias("cents"))
    cents = F.col("cents")
    main = by_customer.select(
        _text(F.col("o_custkey")).alias("facility_id"),
        F.lit("MSPB-1").alias("measure_id"),
        F.lit("Spending per patient").alias("measure_name"),
        F.when(cents % 17 == 0, "Not Available")
        .otherwise(_hundredths(cents % 61 + 70))
        .alias("score"),
        F.lit("").alias("footnote"),
        F.lit("01/01/2024").alias("start_date"),
        F.lit("12/31/2024").alias("end_date"),
    )
    second = by_customer.where(F.col("o_custkey") % 10 == 0).select(
        _text(F.col("o_custkey")).alias("facility_id"),
        F.lit("MSPB-ALT").alias("measure_id"),
        F.lit("Second spending measure").alias("measure_name"),
        F.lit("1.50").alias("score"),
        F.lit("1").alias("footnote"),
        F.lit("").alias("start_date"),
        F.lit("").alias("end_date"),
    )
    return main.unionByName(second)


def _complications(by_priority: DataFrame, spark: SparkSession) -> DataFrame:
    cents, prio = F.col("cents"), F.col("prio")
    real = by_priority.select(
        pad_id(_text(F.col("o_custkey"))).alias("facility_id"),
        _pick(prio, COMPLICATION_MEASURES, "COMP_HIP_KNEE").alias("measure_id"),
        F.concat(F.lit("Complication measure "), prio).alias("measure_name"),
        _pick(cents % 5, dict(enumerate(NATIONAL_RATE)), "").alias("compared_to_national"),
        _text(F.col("n") * 30).alias("denominator"),
        F.when(cents % 11 == 0, "Not Available")
        .otherwise(_hundredths(cents % 2000))
        .alias("score"),
        F.lit("--").alias("lower_estimate"),
        F.lit("-0.5").alias("higher_estimate"),
    )
    orphan = spark.range(1).select(
        F.lit("999999").alias("facility_id"),
        F.lit("MORT_30_HF").alias("measure_id"),
        F.lit("Complication measure 1").alias("measure_name"),
        F.lit("Worse Than the National Rate").alias("compared_to_national"),
        F.lit("10").alias("denominator"),
        F.lit("9.9").alias("score"),
        F.lit("").alias("lower_estimate"),
        F.lit("").alias("higher_estimate"),
    )
    return real.unionByName(orphan).select(
        "*", F.lit("07/01/2021").alias("start_date"), F.lit("06/30/2024").alias("end_date")
    )


def _infections(events: DataFrame) -> DataFrame:
    grouped = events.groupBy("user_id", "event_type").agg(F.sum(_cents("value")).alias("cents"))
    cents, kind = F.col("cents"), F.col("event_type")
    return grouped.select(
        _text(F.col("user_id")).alias("facility_id"),
        _pick(kind, INFECTION_MEASURES, "HAI_1_CILOWER").alias("measure_id"),
        F.concat(F.lit("Infection "), kind).alias("measure_name"),
        _pick(cents % 4, dict(enumerate(NATIONAL_BENCHMARK)), "Not Available").alias(
            "compared_to_national"
        ),
        F.when(cents % 13 == 0, "Not Available")
        .when(cents % 19 == 0, "0")
        .otherwise(_hundredths(cents % 250))
        .alias("score"),
        F.lit("01/01/2024").alias("start_date"),
        F.lit("12/31/2024").alias("end_date"),
    )


def _unplanned_visits(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    # Sums per order first: an order with very many lines reaches the join as a few rows.
    per_order = lineitem.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(
        F.sum(_cents("l_extendedprice")).alias("cents"), F.count(F.lit(1)).alias("n")
    )
    grouped = (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_returnflag", "l_linestatus")
        .agg(F.sum("cents").alias("cents"), F.sum("n").alias("n"))
        .withColumn("flags", F.concat("l_returnflag", "l_linestatus"))
    )
    flags, cents, n = F.col("flags"), F.col("cents"), F.col("n")
    return grouped.select(
        pad_id(_text(F.col("o_custkey"))).alias("facility_id"),
        _pick(flags, VISIT_MEASURES, "Hybrid_HWR").alias("measure_id"),
        F.concat(F.lit("Visit measure "), flags).alias("measure_name"),
        F.lit("Not Available").alias("compared_to_national"),
        _text(n * 25).alias("denominator"),
        F.when(flags == "RO", "Not Available")
        .otherwise(_hundredths(cents % 1200 + 1500))
        .alias("score"),
        F.concat(F.lit("1,"), zero_padded(_text(n), 3)).alias("number_of_patients"),
        F.lit("Not Applicable").alias("number_of_patients_returned"),
        F.when(flags == "RO", "5").otherwise("").alias("footnote"),
        F.lit("07/01/2021").alias("start_date"),
        F.lit("06/30/2024").alias("end_date"),
    )


def _patient_survey(by_priority: DataFrame) -> DataFrame:
    cents, prio = F.col("cents"), F.col("prio")
    recommend = prio == "4"
    ids = {p: measure for p, (measure, _) in SURVEY_MEASURES.items()}
    questions = {p: question for p, (_, question) in SURVEY_MEASURES.items()}
    return by_priority.select(
        _text(F.col("o_custkey")).alias("facility_id"),
        _pick(prio, ids, "H_CLEAN_STAR_RATING").alias("hcahps_measure_id"),
        _pick(prio, questions, "Cleanliness - star rating").alias("hcahps_question"),
        F.concat(F.lit("answer "), prio).alias("hcahps_answer_description"),
        F.when(recommend, "Not Applicable")
        .when(cents % 9 == 0, "Not Available")
        .otherwise(_text(cents % 5 + 1))
        .alias("patient_survey_star_rating"),
        F.when(recommend, _text(cents % 60 + 40))
        .otherwise("Not Applicable")
        .alias("hcahps_answer_percent"),
        _text(cents % 40 + 60).alias("hcahps_linear_mean_value"),
        F.when(cents % 7 == 0, F.concat(F.lit("1,"), F.lpad(_text(cents % 1000), 3, "0")))
        .when(cents % 8 == 0, "Not Available")
        .otherwise(_text(cents % 1000))
        .alias("number_of_completed_surveys"),
        _text(cents % 50 + 10).alias("survey_response_rate_percent"),
        F.lit("07/01/2023").alias("start_date"),
        F.lit("06/30/2024").alias("end_date"),
    )


def raw_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six raw sources over the Parquet tables in ``folder``."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")

    orders = table("orders").select(
        "o_custkey",
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).alias("prio"),
        _cents("o_totalprice").alias("cents"),
    )
    by_priority = orders.groupBy("o_custkey", "prio").agg(
        F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n")
    )
    sources = {
        "hospital_info": _hospital_info(table("customer")),
        "complications": _complications(by_priority, spark),
        "infections": _infections(table("events")),
        "unplanned_visits": _unplanned_visits(
            table("lineitem"), orders.select("o_orderkey", "o_custkey")
        ),
        "patient_survey": _patient_survey(by_priority),
        "spending": _spending(orders),
    }
    return {name: _layout(name, df) for name, df in sources.items()}
