"""Questions asked outside the shared dashboard, and variants of its questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starward.functions.measures import (
    SAFETY_INDEX,
    correlation,
    mean,
    ratio,
    rounded,
    rows,
)
from starward.plans import dashboard as d
from starward.plans.explore import survey_stars
from starward.plans.warehouse import Star
from starward.sources.shared import write_shared

# '_' is a wildcard in these two patterns.
READMISSIONS = "READM_30_%"
DEATHS = "MORT_30_%"


def spending_vs_readmission_with_correlation(star: Star) -> DataFrame:
    points = d.readmission_points(star)
    overall = points.agg(correlation(ratio(), F.col("hf_readmission_pct"), 3)).scalar()
    return d.readmission_point_columns(points, overall.alias("natl_correlation"))


def best_value_hospitals(star: Star, best: int = 3) -> DataFrame:
    """Per state the cheapest 4-5 star hospitals, with their distance to the state's mean.

    The mean is over all hospitals with a ratio, before the star filter. Hospitals that tie on
    (ratio, stars) share a rank, however many they are, so ranks are worked out on the distinct
    pairs of a state: the first ``best`` pairs are enough, and what is broadcast is ``best``
    rows for each two-letter state code.
    """
    rated = write_shared(
        star.spending().join(d.hospitals(star, "state", "overall_rating"), "facility_id"), "rated"
    )
    state_means = rated.groupBy("state").agg(F.avg(ratio()).alias("state_mean"))
    pair = ["state", "mspb_ratio", "overall_rating"]
    order = Window.partitionBy("state").orderBy("mspb_ratio", F.desc("overall_rating"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked_pairs = (
        rated.where(F.col("overall_rating") >= 4)
        .groupBy(*pair)
        .agg(rows().alias("n"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= best)
        .withColumn("value_rank", F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1)
        .where(F.col("value_rank") <= best)
        .join(state_means, "state")
        .select(*pair, "value_rank", "state_mean")
    )
    readmissions = d.hf_readmissions(star)
    return (
        rated.join(F.broadcast(ranked_pairs), pair)
        .join(d.hospitals(star, *"facility_name city_town county_parish zip_code".split()), "facility_id")
        .join(readmissions, "facility_id", "left")
        .orderBy("state", "value_rank", "facility_id")
        .select(
            "state",
            F.col("value_rank").cast("int").alias("value_rank"),
            *"facility_name city_town county_parish zip_code".split(),
            F.col("overall_rating").cast("int").alias("overall_rating"),
            ratio().cast("double").alias("mspb_ratio"),
            rounded(ratio() - F.col("state_mean"), 3).alias("mspb_vs_state_avg"),
            F.col("hf_readmission_pct").cast("double").alias("hf_readmission_pct"),
        )
    )


def for_profit_mix_with_correlation(star: Star) -> DataFrame:
    """The correlation is over the rounded state columns."""
    mix = d.for_profit_mix_by_state(star)
    overall = mix.agg(correlation(F.col("pct_for_profit"), F.col("avg_mspb"), 3)).scalar()
    return mix.withColumn("corr_for_profit_vs_spend", overall)


def _hospital_means(star: Star, fact: str, pattern: str, name: str) -> DataFrame:
    return (
        star[fact]
        .where(F.col("measure_id").like(pattern) & F.col("score").isNotNull())
        .groupBy("facility_id")
        .agg(F.avg("score").alias(name), rows().alias("measures_reported"))
    )


def spending_vs_all_readmissions(star: Star) -> DataFrame:
    means = _hospital_means(star, "fact_unplanned_visits", READMISSIONS, "mean_pct")
    return (
        star.spending()
        .join(means, "facility_id")
        .join(d.hospitals(star, "facility_name", "state", "hospital_ownership"), "facility_id")
        .orderBy("mspb_ratio", "facility_id")
        .select(
            "facility_id",
            "facility_name",
            "state",
            "hospital_ownership",
            ratio().cast("double").alias("mspb_ratio"),
            rounded(F.col("mean_pct"), 2).alias("avg_readmission_pct"),
            "measures_reported",
        )
    )


def all_outcomes_by_spending_quartile(star: Star) -> DataFrame:
    """Means of per-hospital means; every outcome says how many hospitals it covers."""
    measure, score = F.col("measure_id"), F.col("score")
    deaths_and_safety = (
        star["fact_complications_deaths"]
        .where(score.isNotNull() & (measure.like(DEATHS) | (measure == SAFETY_INDEX)))
        .groupBy("facility_id")
        .agg(
            F.avg(F.when(measure.like(DEATHS), score)).alias("mortality"),
            F.max(F.when(measure == SAFETY_INDEX, score)).alias("psi_90"),
        )
    )
    readmissions = _hospital_means(
        star, "fact_unplanned_visits", READMISSIONS, "readmission"
    ).drop("measures_reported")
    label = (
        F.when(F.col("quartile") == 1, "Q1 Lowest spend")
        .when(F.col("quartile") == 4, "Q4 Highest spend")
        .otherwise(F.concat(F.lit("Q"), F.col("quartile").cast("string")))
    )
    return (
        star.spending_quartiles()
        .join(deaths_and_safety, "facility_id", "left")
        .join(d.hospital_infection_means(star), "facility_id", "left")
        .join(readmissions, "facility_id", "left")
        .join(survey_stars(star), "facility_id", "left")
        .groupBy("quartile")
        .agg(
            rows().alias("hospitals"),
            rounded(F.min(ratio()), 2).alias("min_mspb"),
            rounded(F.max(ratio()), 2).alias("max_mspb"),
            rounded(F.avg("mortality"), 2).alias("avg_mortality_pct"),
            mean(F.col("psi_90"), 3).alias("avg_psi_90"),
            rounded(F.avg("avg_sir"), 3).alias("avg_infection_sir"),
            rounded(F.avg("readmission"), 2).alias("avg_readmission_pct"),
            mean(F.col("star_rating"), 2).alias("avg_patient_stars"),
            F.count("mortality").alias("n_mortality"),
            F.count("avg_sir").alias("n_infections"),
            F.count("readmission").alias("n_readmit"),
            F.count("star_rating").alias("n_patient"),
        )
        .orderBy("quartile")
        .select(
            F.col("quartile").alias("spend_quartile"),
            label.alias("spend_group"),
            *"hospitals min_mspb max_mspb avg_mortality_pct avg_psi_90".split(),
            *"avg_infection_sir avg_readmission_pct avg_patient_stars".split(),
            *"n_mortality n_infections n_readmit n_patient".split(),
        )
    )


def rows_per_spending_measure(star: Star) -> DataFrame:
    return star["fact_spending"].groupBy("measure_id").agg(rows().alias("count"))


def measures_of_domain(star: Star, domain: str = "Unplanned Visits") -> DataFrame:
    return (
        star["dim_measure"]
        .where(F.col("measure_domain") == domain)
        .select("measure_id", "measure_name")
    )


def footnotes_of_measure(star: Star, measure: str = "Hybrid_HWR") -> DataFrame:
    return (
        star["fact_unplanned_visits"]
        .where(F.col("measure_id") == measure)
        .groupBy("footnote", "compared_to_national")
        .agg(rows().alias("count"))
    )


def state_spending_and_stars(star: Star, minimum: int = 10) -> DataFrame:
    """Inner join: only hospitals with a ratio count towards the star average."""
    return (
        star.spending(None)
        .join(d.hospitals(star, "state", "overall_rating"), "facility_id")
        .groupBy("state")
        .agg(
            F.count(ratio()).alias("hospitals"),
            mean(ratio(), 3).alias("avg_spending_ratio"),
            mean(F.col("overall_rating"), 2).alias("avg_star_rating"),
        )
        .where(F.col("hospitals") >= minimum)
        .orderBy(F.desc_nulls_first("avg_spending_ratio"), "state")
    )


def stars_by_state(star: Star, minimum: int = 5) -> DataFrame:
    return (
        star["dim_hospital"]
        .groupBy("state")
        .agg(rows().alias("hospitals"), mean(F.col("overall_rating"), 2).alias("avg_rating"))
        .where(F.col("hospitals") >= minimum)
        .orderBy(F.desc_nulls_last("avg_rating"), "state")
    )


def state_spending(star: Star) -> DataFrame:
    return d.mortality_by_state(star, None).select("state", "avg_spending_ratio")


def state_mortality(star: Star) -> DataFrame:
    return d.mortality_by_state(star, None).select("state", "avg_hf_mortality")


def load_log_listing(star: Star) -> DataFrame:
    return (
        star["load_log"]
        .select("dataset_id", "title", "rows_loaded", "loaded_at")
        .orderBy("dataset_id")
    )


def first_hospitals(star: Star, limit: int = 200) -> DataFrame:
    return (
        d.hospitals(
            star,
            *"facility_name city_town state hospital_type hospital_ownership".split(),
            "overall_rating",
        )
        .withColumn("overall_rating", F.col("overall_rating").cast("int"))
        .orderBy("state", "facility_name", "facility_id")
        .limit(limit)
    )
