"""Exploratory questions and headline numbers. Each takes a Star, gives a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starward.functions.measures import (
    HF_READMISSION,
    SPENDING,
    SURVEY_STARS,
    correlation,
    mean,
    percent,
    rating,
    ratio,
    rows,
    rows_where,
    spending_level,
    star_label,
    star_label_or_unrated,
)
from starward.operators.statistics import approximate_percentiles
from starward.plans.warehouse import Star
from starward.sources.schemas import FACTS, STAR_TABLES


def survey_stars(star: Star) -> DataFrame:
    """(facility_id, star_rating) of the summary rating, rated hospitals only."""
    return (
        star["fact_patient_survey"]
        .where((F.col("measure_id") == SURVEY_STARS) & F.col("star_rating").isNotNull())
        .select("facility_id", F.col("star_rating").cast("int").alias("star_rating"))
    )


def table_rows(star: Star) -> DataFrame:
    counts = [
        star[table]
        .agg(rows().alias("row_count"))
        .select(F.lit(table).alias("table_name"), "row_count")
        for table in STAR_TABLES
    ]
    return reduce(DataFrame.unionByName, counts)


def measures_per_domain(star: Star) -> DataFrame:
    return (
        star["dim_measure"]
        .groupBy("measure_domain")
        .agg(rows().alias("measures"))
        .orderBy(F.desc("measures"), "measure_domain")
    )


def hospitals_by_type_and_ownership(star: Star) -> DataFrame:
    return (
        star["dim_hospital"]
        .groupBy("hospital_type", "hospital_ownership")
        .agg(
            rows().alias("hospitals"),
            percent(F.count("overall_rating"), rows(), 1).alias("pct_rated"),
            mean(F.col("overall_rating"), 2).alias("avg_star_rating"),
        )
        .orderBy(F.desc("hospitals"), "hospital_type", "hospital_ownership")
    )


def star_distribution(star: Star) -> DataFrame:
    """Unrated hospitals are a group of their own and come last."""
    return (
        star["dim_hospital"]
        .groupBy(rating())
        .agg(rows().alias("hospitals"))
        .orderBy(F.asc_nulls_last("overall_rating"))
    )


def star_distribution_labelled(star: Star) -> DataFrame:
    return (
        star["dim_hospital"]
        .groupBy("overall_rating")
        .agg(rows().alias("hospitals"))
        .orderBy(F.asc_nulls_last("overall_rating"))
        .select(star_label_or_unrated(F.col("overall_rating")).alias("star_rating"), "hospitals")
    )


def spending_summary(star: Star) -> DataFrame:
    """Over every spending measure."""
    return star["fact_spending"].agg(
        F.count(ratio()).alias("hospitals_with_score"),
        F.min(ratio()).cast("double").alias("min_ratio"),
        F.max(ratio()).cast("double").alias("max_ratio"),
        mean(ratio(), 3).alias("avg_ratio"),
    )


def _spending_by_stars(star: Star) -> DataFrame:
    rated = star["dim_hospital"].where(F.col("overall_rating").isNotNull())
    return (
        star.spending(None)
        .join(rated.select("facility_id", rating()), "facility_id")
        .groupBy("overall_rating")
        .agg(rows().alias("hospitals"), mean(ratio(), 3).alias("avg_spending_ratio"))
        .orderBy("overall_rating")
    )


def spending_by_stars(star: Star) -> DataFrame:
    return _spending_by_stars(star)


def spending_by_stars_labelled(star: Star) -> DataFrame:
    return _spending_by_stars(star).select(
        star_label(F.col("overall_rating")).alias("star_rating"), "avg_spending_ratio", "hospitals"
    )


def survey_stars_by_spending_level(star: Star) -> DataFrame:
    return (
        star.spending(None)
        .join(survey_stars(star), "facility_id")
        .groupBy(spending_level(ratio()).alias("spending_level"))
        .agg(
            F.count("star_rating").alias("hospitals"),
            mean(F.col("star_rating"), 2).alias("avg_patient_stars"),
        )
        .orderBy("spending_level")
    )


def worse_mortality_by_ownership(star: Star) -> DataFrame:
    compared = F.col("compared_to_national")
    worse = rows_where(compared.startswith("Worse"))
    return (
        star["fact_complications_deaths"]
        .where(F.col("measure_id").startswith("MORT") & compared.isNotNull())
        .select("facility_id", "compared_to_national")
        .join(star["dim_hospital"].select("facility_id", "hospital_ownership"), "facility_id")
        .groupBy("hospital_ownership")
        .agg(
            F.count(compared).alias("rated_results"),
            worse.alias("worse_results"),
            percent(worse, F.count(compared), 2).alias("pct_worse"),
        )
        .orderBy(F.desc_nulls_first("pct_worse"), "hospital_ownership")
    )


def infection_ratio_by_measure(star: Star) -> DataFrame:
    """Grouped by measure before the join, which then sees one row per measure."""
    by_measure = (
        star["fact_infections"]
        .where(F.col("measure_id").endswith("SIR"))
        .groupBy("measure_id")
        .agg(
            F.count("score").alias("hospitals_reporting"), mean(F.col("score"), 3).alias("avg_sir")
        )
    )
    return (
        by_measure.join(star["dim_measure"].select("measure_id", "measure_name"), "measure_id")
        .select("measure_id", "measure_name", "hospitals_reporting", "avg_sir")
        .orderBy("measure_id")
    )


def approximate_score_percentiles(star: Star, accuracy: int = 10_000) -> DataFrame:
    """Three percentiles of every scored measure of complications and deaths, from sketches."""
    points = {"p10": 0.10, "median": 0.50, "p90": 0.90}
    scored = star["fact_complications_deaths"].where(F.col("score").isNotNull())
    return approximate_percentiles(
        scored.select("measure_id", "score"), "score", points, ["measure_id"], accuracy
    ).orderBy("measure_id")


def spending_and_stars_by_state(star: Star, minimum: int = 10) -> DataFrame:
    """Left join: the star average covers hospitals without a spending row, too."""
    spending = star["fact_spending"].select("facility_id", "mspb_ratio")
    return (
        star["dim_hospital"]
        .select("facility_id", "state", "overall_rating")
        .join(spending, "facility_id", "left")
        .groupBy("state")
        .agg(
            F.count("mspb_ratio").alias("hospitals_with_spending"),
            mean(ratio(), 3).alias("avg_spending_ratio"),
            mean(F.col("overall_rating"), 2).alias("avg_star_rating"),
        )
        .where(F.col("hospitals_with_spending") >= minimum)
        .orderBy(F.desc_nulls_first("avg_spending_ratio"), "state")
    )


def top_readmission_states(star: Star, minimum: int = 5, limit: int = 10) -> DataFrame:
    return (
        star["fact_unplanned_visits"]
        .where(F.col("measure_id") == HF_READMISSION)
        .select("facility_id", "score")
        .join(star["dim_hospital"].select("facility_id", "state"), "facility_id")
        .groupBy("state")
        .agg(
            F.count("score").alias("hospitals_reporting"),
            mean(F.col("score"), 2).alias("avg_hf_readmission_rate_pct"),
        )
        .where(F.col("hospitals_reporting") >= minimum)
        .orderBy(F.desc_nulls_first("avg_hf_readmission_rate_pct"), "state")
        .limit(limit)
    )


def periods_by_domain(star: Star) -> DataFrame:
    """Fact rows are counted per measure and period before any join."""
    used = [
        star[fact].groupBy("measure_id", "period_id").agg(rows().alias("n")) for fact in FACTS
    ]
    return (
        reduce(DataFrame.unionByName, used)
        .join(star["dim_measure"].select("measure_id", "measure_domain"), "measure_id")
        .join(star["dim_period"], "period_id", "left")
        .groupBy("measure_domain", "start_date", "end_date")
        .agg(F.sum("n").alias("results"))
        .orderBy("measure_domain", F.asc_nulls_last("start_date"), F.asc_nulls_last("end_date"))
    )


def spot_check(star: Star, facility_id: str = "010001") -> DataFrame:
    """One hospital with its ratio and survey stars; the filter reaches all three scans."""
    chosen = F.col("facility_id") == facility_id
    survey = star["fact_patient_survey"].where(chosen & (F.col("measure_id") == SURVEY_STARS))
    return (
        star["dim_hospital"]
        .where(chosen)
        .select("facility_id", "facility_name", "city_town", "state", rating())
        .join(
            star["fact_spending"]
            .where(chosen)
            .select("facility_id", ratio().cast("double").alias("mspb_ratio")),
            "facility_id",
            "left",
        )
        .join(
            survey.select(
                "facility_id", F.col("star_rating").cast("int").alias("patient_survey_stars")
            ),
            "facility_id",
            "left",
        )
    )


def scored_hospitals(star: Star) -> DataFrame:
    return star.spending(SPENDING).agg(rows().alias("hospitals"))


def spending_star_correlation(star: Star) -> DataFrame:
    rated = star["dim_hospital"].where(F.col("overall_rating").isNotNull())
    return (
        star.spending()
        .join(rated.select("facility_id", "overall_rating"), "facility_id")
        .agg(correlation(ratio(), F.col("overall_rating"), 3).alias("correlation"))
    )


def top_rated_share(star: Star) -> DataFrame:
    return (
        star["dim_hospital"]
        .where(F.col("overall_rating").isNotNull())
        .agg(percent(rows_where(F.col("overall_rating") >= 4), rows(), 1).alias("pct_4_or_5_star"))
    )
