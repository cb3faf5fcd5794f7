"""The dashboard questions: spending against stars, outcomes, experience, owners and places.

``spending_measure=None`` takes every spending measure instead of the main one; a hospital
with two measures then counts twice, as in the questions that do not name a measure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starward.functions.measures import (
    ACUTE_CARE,
    FOR_PROFIT,
    HF_DEATH,
    HF_READMISSION,
    INFECTION_RATIO,
    RECOMMEND,
    SAFETY_INDEX,
    SPENDING,
    SURVEY_STARS,
    census_region,
    exact,
    infection_range,
    mean,
    number,
    ownership_group,
    percent,
    quartile_label,
    ratio,
    rounded,
    rounded_float,
    rows,
    rows_where,
    spending_level,
    spread,
    star_label_or_unrated,
    value_group,
)
from starward.operators.joins import join_lookup
from starward.operators.ordering import global_ranks
from starward.operators.statistics import exact_percentiles, measure_columns, with_share
from starward.plans.explore import survey_stars
from starward.plans.warehouse import Star
from starward.sources.shared import write_shared


def scores(star: Star, fact: str, measure: str, name: str, *more: str) -> DataFrame:
    """(facility_id, name) of one measure, scored rows only."""
    return (
        star[fact]
        .where((F.col("measure_id") == measure) & F.col("score").isNotNull())
        .select("facility_id", F.col("score").alias(name), *more)
    )


def hf_readmissions(star: Star, name: str = "hf_readmission_pct") -> DataFrame:
    return scores(star, "fact_unplanned_visits", HF_READMISSION, name)


def hf_deaths(star: Star, name: str = "hf_death_pct") -> DataFrame:
    return scores(star, "fact_complications_deaths", HF_DEATH, name)


def infection_scores(star: Star, pattern: str = INFECTION_RATIO) -> DataFrame:
    return (
        star["fact_infections"]
        .where(F.col("measure_id").like(pattern) & F.col("score").isNotNull())
        .select("facility_id", "measure_id", "score")
    )


def hospitals(star: Star, *columns: str) -> DataFrame:
    return star["dim_hospital"].select("facility_id", *columns)


# --- headline ---------------------------------------------------------------------------


def outcomes_by_spending_quartile(star: Star) -> DataFrame:
    outcomes = measure_columns(
        star["fact_complications_deaths"],
        {"hf_death_pct": (HF_DEATH, "score"), "psi_90": (SAFETY_INDEX, "score")},
    )
    label = (
        F.when(F.col("quartile") == 1, " (lowest spend)")
        .when(F.col("quartile") == 4, " (highest spend)")
        .otherwise("")
    )
    return (
        star.spending_quartiles()
        .join(hospitals(star, "overall_rating"), "facility_id")
        .join(hf_readmissions(star), "facility_id", "left")
        .join(outcomes, "facility_id", "left")
        .groupBy("quartile")
        .agg(
            rows().alias("hospitals"),
            F.min(ratio()).cast("double").alias("min_mspb"),
            F.max(ratio()).cast("double").alias("max_mspb"),
            mean(F.col("overall_rating"), 2).alias("avg_star_rating"),
            mean(F.col("hf_readmission_pct"), 2).alias("avg_hf_readmission_pct"),
            mean(F.col("hf_death_pct"), 2).alias("avg_hf_death_pct"),
            mean(F.col("psi_90"), 3).alias("avg_psi_90"),
        )
        .orderBy("quartile")
        .select(
            F.concat(quartile_label(F.col("quartile")), label).alias("spending_quartile"),
            *"hospitals min_mspb max_mspb avg_star_rating".split(),
            *"avg_hf_readmission_pct avg_hf_death_pct avg_psi_90".split(),
        )
    )


def top_rated_by_spending_level(star: Star, spending_measure: str | None = SPENDING) -> DataFrame:
    rating = F.col("overall_rating")
    top = rows_where(rating >= 4)
    return (
        star.spending(spending_measure)
        .join(hospitals(star, "overall_rating").where(rating.isNotNull()), "facility_id")
        .groupBy(spending_level(ratio()).alias("spending_level"))
        .agg(
            F.count(rating).alias("rated_hospitals"),
            top.alias("top_rated"),
            percent(top, F.count(rating), 1).alias("pct_top_rated"),
        )
        .orderBy("spending_level")
    )


# --- distributions ----------------------------------------------------------------------


def spending_histogram(star: Star) -> DataFrame:
    """Bands of 0.05, cut on exact decimals: 0.95 belongs to the band that starts there."""
    band = F.floor(ratio() * 20) * number("0.05")
    counts = star.spending().groupBy(rounded(band, 2).alias("spending_bucket")).agg(
        rows().alias("hospitals")
    )
    return with_share(counts, "hospitals", "pct_of_hospitals").orderBy("spending_bucket")


def star_rating_distributions(star: Star) -> DataFrame:
    ratings = {
        "CMS overall rating": star["dim_hospital"].select(F.col("overall_rating").alias("stars")),
        "Patient survey rating": survey_stars(star).select(F.col("star_rating").alias("stars")),
    }
    shares = [
        with_share(
            df.where(F.col("stars").isNotNull())
            .groupBy(F.col("stars").cast("int").alias("stars"))
            .agg(rows().alias("hospitals")),
            "hospitals",
            "pct_of_hospitals",
        ).select(F.lit(label).alias("rating_type"), "stars", "hospitals", "pct_of_hospitals")
        for label, df in ratings.items()
    ]
    return reduce(DataFrame.unionByName, shares).orderBy("rating_type", "stars")


def hf_rate_distributions(star: Star) -> DataFrame:
    outcomes = {
        "HF readmission": hf_readmissions(star, "rate"),
        "HF death": hf_deaths(star, "rate"),
    }
    shares = [
        with_share(
            df.groupBy(F.floor("rate").cast("int").alias("rate_pct_bucket")).agg(
                rows().alias("hospitals")
            ),
            "hospitals",
            "pct_of_hospitals",
        ).select(F.lit(label).alias("outcome"), "rate_pct_bucket", "hospitals", "pct_of_hospitals")
        for label, df in outcomes.items()
    ]
    return reduce(DataFrame.unionByName, shares).orderBy("outcome", "rate_pct_bucket")


def infection_distribution(star: Star) -> DataFrame:
    counts = (
        infection_scores(star)
        .groupBy(infection_range(F.col("score")).alias("sir_bucket"))
        .agg(rows().alias("hospital_results"))
    )
    return with_share(counts, "hospital_results", "pct_of_results").orderBy("sir_bucket")


def metric_spread(star: Star) -> DataFrame:
    """Five metrics side by side; each covers the hospitals that report it."""
    value = F.col("metric_value")
    # Metric names.
    metrics = {
        "Medicare spending ratio (1.0 = national median)": star.spending().select(
            ratio().alias("metric_value")
        ),
        "CMS overall star rating (1-5)": star["dim_hospital"]
        .where(F.col("overall_rating").isNotNull())
        .select(exact(F.col("overall_rating")).alias("metric_value")),
        "Heart-failure 30-day readmission rate (%)": hf_readmissions(star, "metric_value"),
        "Heart-failure 30-day mortality rate (%)": hf_deaths(star, "metric_value"),
        "Patient safety index (PSI-90)": scores(
            star, "fact_complications_deaths", SAFETY_INDEX, "metric_value"
        ),
    }
    long = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(name).alias("metric"), "metric_value") for name, df in metrics.items()],
    )
    long = write_shared(long, "metrics")  # read by the basics and by the percentiles
    basics = long.groupBy("metric").agg(
        rows().alias("hospitals"),
        mean(value, 3).alias("mean_value"),
        spread(value, 3).alias("std_dev"),
        rounded_float(
            F.try_divide(F.stddev_samp(value) * 100, F.avg(value).cast("double")), 1
        ).alias("cv_pct"),
        rounded(F.min(value), 3).alias("min_value"),
        rounded(F.max(value), 3).alias("max_value"),
    )
    points = {"p10": 0.10, "median": 0.50, "p90": 0.90}
    percentiles = exact_percentiles(long, "metric_value", points, ["metric"])
    return (
        basics.join(percentiles, "metric")
        .select(
            "metric",
            *"hospitals mean_value std_dev cv_pct min_value".split(),
            *[rounded_float(F.col(name), 3).alias(name) for name in points],
            "max_value",
        )
        .orderBy(F.desc_nulls_first("cv_pct"), "metric")
    )


def readmission_spread_by_quartile(star: Star) -> DataFrame:
    score = F.col("score")
    joined = (
        star.spending_quartiles()
        .select("facility_id", "quartile")
        .join(hf_readmissions(star, "score"), "facility_id")
    )
    joined = write_shared(joined.select("quartile", "score"), "quartile-scores")
    basics = joined.groupBy("quartile").agg(
        F.count(score).alias("hospitals"),
        rounded(F.min(score), 2).alias("min_pct"),
        rounded(F.max(score), 2).alias("max_pct"),
        spread(score, 2).alias("std_dev_pct"),
    )
    points = {"p10_pct": 0.10, "median_pct": 0.50, "p90_pct": 0.90}
    percentiles = exact_percentiles(joined, "score", points, ["quartile"])
    return (
        basics.join(percentiles, "quartile")
        .orderBy("quartile")
        .select(
            quartile_label(F.col("quartile")).alias("spending_quartile"),
            "hospitals",
            "min_pct",
            *[rounded_float(F.col(name), 2).alias(name) for name in points],
            "max_pct",
            "std_dev_pct",
        )
    )


def spread_within_states(star: Star, minimum: int = 10) -> DataFrame:
    return (
        star.spending()
        .join(hospitals(star, "state", "overall_rating"), "facility_id")
        .groupBy("state")
        .agg(
            rows().alias("hospitals"),
            mean(ratio(), 3).alias("avg_mspb"),
            rounded(F.min(ratio()), 3).alias("min_mspb"),
            rounded(F.max(ratio()), 3).alias("max_mspb"),
            spread(ratio(), 3).alias("sd_mspb"),
            mean(F.col("overall_rating"), 2).alias("avg_star_rating"),
            spread(F.col("overall_rating"), 2).alias("sd_star_rating"),
        )
        .where(F.col("hospitals") >= minimum)
        .orderBy(F.desc_nulls_first("sd_mspb"), "state")
    )


# --- clinical outcomes ------------------------------------------------------------------


def readmission_points(star: Star, minimum_cases: int = 150) -> DataFrame:
    """(hospital columns, ratio, rate) of hospitals with enough cases, types as stored.

    Written once, since ranks, correlation and the final sort all read them.
    """
    enough = scores(
        star, "fact_unplanned_visits", HF_READMISSION, "hf_readmission_pct", "denominator"
    ).where(F.col("denominator") >= minimum_cases)
    points = (
        star.spending()
        .join(enough.drop("denominator"), "facility_id")
        .join(
            hospitals(star, "facility_name", "city_town", "state", "overall_rating"),
            "facility_id",
        )
    )
    return write_shared(points, "points")


def readmission_point_columns(points: DataFrame, *more) -> DataFrame:
    """The points with their spending percentile, cheapest first."""
    return (
        global_ranks(points, "mspb_ratio", percent_rank="share")
        .orderBy("mspb_ratio", "facility_id")
        .select(
            "facility_name",
            "city_town",
            "state",
            star_label_or_unrated(F.col("overall_rating")).alias("star_rating"),
            ratio().cast("double").alias("mspb_ratio"),
            F.col("hf_readmission_pct").cast("double").alias("hf_readmission_pct"),
            rounded_float(F.col("share") * 100, 1).alias("spend_percentile"),
            *more,
        )
    )


def spending_vs_readmission(star: Star) -> DataFrame:
    return readmission_point_columns(readmission_points(star))


def spending_vs_mortality(star: Star, spending_measure: str | None = SPENDING) -> DataFrame:
    return (
        star.spending(spending_measure)
        .join(hf_deaths(star, "mortality_rate"), "facility_id")
        .join(hospitals(star, "facility_name"), "facility_id")
        .orderBy("mspb_ratio", "facility_id")
        .select(
            "facility_id",
            "facility_name",
            ratio().cast("double").alias("spending_ratio"),
            F.col("mortality_rate").cast("double").alias("mortality_rate"),
        )
    )


def infections_by_type_and_quartile(star: Star) -> DataFrame:
    """Names are looked up after the grouping by measure; measures may share a name."""
    by_measure = (
        star.spending_quartiles()
        .select("facility_id", "quartile")
        .join(infection_scores(star), "facility_id")
        .groupBy("quartile", "measure_id")
        .agg(rows().alias("n"), F.sum("score").alias("total"))
    )
    return (
        by_measure.join(star["dim_measure"].select("measure_id", "measure_name"), "measure_id")
        .groupBy("quartile", "measure_name")
        .agg(
            F.sum("n").alias("hospitals"),
            rounded(
                F.try_divide(
                    F.sum("total").cast("decimal(28,10)"), F.sum("n").cast("decimal(18,0)")
                ),
                3,
            ).alias("avg_infection_ratio"),
        )
        .orderBy("measure_name", "quartile")
        .select(
            quartile_label(F.col("quartile")).alias("spending_quartile"),
            F.col("measure_name").alias("infection_type"),
            "hospitals",
            "avg_infection_ratio",
        )
    )


def hospital_infection_means(star: Star) -> DataFrame:
    return (
        infection_scores(star, "%SIR").groupBy("facility_id").agg(F.avg("score").alias("avg_sir"))
    )


def infections_by_spending_level(star: Star, spending_measure: str | None = SPENDING) -> DataFrame:
    return (
        star.spending(spending_measure)
        .join(hospital_infection_means(star), "facility_id")
        .groupBy(spending_level(ratio()).alias("spending_level"))
        .agg(rows().alias("hospitals"), rounded(F.avg("avg_sir"), 3).alias("avg_infection_sir"))
        .orderBy("spending_level")
    )


def better_or_worse_by_spending_level(star: Star) -> DataFrame:
    compared = F.col("compared_to_national")
    better, worse = compared.startswith("Better"), compared.startswith("Worse")
    results = (
        star["fact_complications_deaths"]
        .where(better | compared.startswith("No Different") | worse)
        .select("facility_id", "compared_to_national")
    )
    return (
        star.spending()
        .join(results, "facility_id")
        .groupBy(spending_level(ratio()).alias("spending_level"))
        .agg(
            rows().alias("rated_results"),
            percent(rows_where(better), rows(), 2).alias("pct_better"),
            percent(rows_where(worse), rows(), 2).alias("pct_worse"),
        )
        .orderBy("spending_level")
    )


def readmission_by_spending_level(
    star: Star, spending_measure: str | None = SPENDING
) -> DataFrame:
    return (
        star.spending(spending_measure)
        .join(hf_readmissions(star, "score"), "facility_id")
        .groupBy(spending_level(ratio()).alias("spending_level"))
        .agg(
            F.count("score").alias("hospitals"),
            mean(F.col("score"), 2).alias("avg_hf_readmission_pct"),
        )
        .orderBy("spending_level")
    )


# --- patient experience -----------------------------------------------------------------


def spending_by_survey_stars(star: Star, spending_measure: str | None = SPENDING) -> DataFrame:
    return (
        star.spending(spending_measure)
        .join(survey_stars(star), "facility_id")
        .groupBy(F.col("star_rating").alias("patient_star_rating"))
        .agg(mean(ratio(), 4).alias("avg_spending_ratio"), rows().alias("n_hospitals"))
        .orderBy("patient_star_rating")
    )


def survey_topic_gaps(star: Star, minimum: int = 100) -> DataFrame:
    """Stars per survey topic in the lowest against the highest spending quartile.

    Topics are measure names and measures may share one: a hospital is reduced to one row per
    topic before topics are, so distinct hospitals are a plain count.
    """
    answers = (
        star["fact_patient_survey"]
        .where(F.col("star_rating").isNotNull())
        .select("facility_id", "measure_id", "star_rating")
    )
    stars = F.col("star_rating").cast("bigint")
    first, last = F.col("quartile") == 1, F.col("quartile") == 4
    rated = (
        star.spending_quartiles()
        .where(F.col("quartile").isin(1, 4))
        .select("facility_id", "quartile")
        .join(answers, "facility_id")
    )
    names = star["dim_measure"].select("measure_id", "measure_name")
    per_hospital = (
        join_lookup(rated, names, ["measure_id"])
        .groupBy("facility_id", "measure_name")
        .agg(
            F.sum(F.when(first, stars)).alias("low_sum"),
            rows_where(first).alias("low_n"),
            F.sum(F.when(last, stars)).alias("high_sum"),
            rows_where(last).alias("high_n"),
        )
    )
    whole = "decimal(18,0)"
    low = F.try_divide(F.sum("low_sum").cast(whole), F.sum("low_n").cast(whole))
    high = F.try_divide(F.sum("high_sum").cast(whole), F.sum("high_n").cast(whole))
    return (
        per_hospital.groupBy("measure_name")
        .agg(
            rounded(low, 2).alias("lowest_spend_stars"),
            rounded(high, 2).alias("highest_spend_stars"),
            rounded(high - low, 2).alias("star_gap"),
            rows().alias("hospitals"),
        )
        .where(F.col("hospitals") >= minimum)
        .orderBy(F.asc_nulls_last("star_gap"), "measure_name")
        .select(
            F.replace("measure_name", F.lit(" - star rating"), F.lit("")).alias("survey_topic"),
            "lowest_spend_stars",
            "highest_spend_stars",
            "star_gap",
            "hospitals",
        )
    )


def recommendation_points(star: Star, minimum_surveys: int = 100) -> DataFrame:
    """Hospitals with enough surveys: ratio, recommend percent, survey stars."""
    survey = measure_columns(
        star["fact_patient_survey"],
        {
            "pct_definitely_recommend": (RECOMMEND, "answer_percent"),
            "completed_surveys": (RECOMMEND, "completed_surveys"),
            "patient_survey_stars": (SURVEY_STARS, "star_rating"),
        },
    ).where(
        F.col("pct_definitely_recommend").isNotNull()
        & (F.col("completed_surveys") >= minimum_surveys)
    )
    return (
        star.spending()
        .join(survey, "facility_id")
        .join(hospitals(star, "facility_name", "hospital_ownership"), "facility_id")
        .orderBy(
            F.desc("mspb_ratio"), F.asc_nulls_last("patient_survey_stars"), F.asc("facility_id")
        )
        .select(
            "facility_id",
            "facility_name",
            "hospital_ownership",
            ratio().cast("double").alias("mspb_ratio"),
            F.col("pct_definitely_recommend").cast("double").alias("pct_definitely_recommend"),
            F.col("patient_survey_stars").cast("int").alias("patient_survey_stars"),
            "completed_surveys",
        )
    )


# --- ownership --------------------------------------------------------------------------


def stars_and_spending_by_ownership(
    star: Star, minimum: int = 20, spending_measure: str | None = SPENDING
) -> DataFrame:
    """Left join: hospitals without a ratio count, and rows without a score do, too."""
    spending = star["fact_spending"]
    if spending_measure is not None:
        spending = spending.where(F.col("measure_id") == spending_measure)
    return (
        hospitals(star, "hospital_ownership", "overall_rating", "hospital_type")
        .where(F.col("hospital_type") == ACUTE_CARE)
        .join(spending.select("facility_id", "mspb_ratio"), "facility_id", "left")
        .groupBy("hospital_ownership")
        .agg(
            rows().alias("hospitals"),
            mean(F.col("overall_rating"), 2).alias("avg_star_rating"),
            mean(ratio(), 3).alias("avg_spending_ratio"),
        )
        .where(F.col("hospitals") >= minimum)
        .orderBy(F.desc_nulls_first("avg_star_rating"), "hospital_ownership")
    )


def value_groups_by_ownership(star: Star, minimum: int = 50) -> DataFrame:
    acute = star["dim_hospital"].where(F.col("hospital_type") == ACUTE_CARE)
    large = acute.groupBy("hospital_ownership").agg(rows().alias("n")).where(F.col("n") >= minimum)
    grouped = (
        star.spending()
        .join(
            acute.where(F.col("overall_rating").isNotNull()).select(
                "facility_id", "hospital_ownership", "overall_rating"
            ),
            "facility_id",
        )
        .groupBy(
            "hospital_ownership",
            value_group(F.col("overall_rating"), ratio()).alias("value_group"),
        )
        .agg(rows().alias("hospitals"))
    )
    # The size rule depends on the ownership alone, so it can follow the grouping.
    return grouped.join(large, "hospital_ownership", "left_semi").orderBy(
        "hospital_ownership", "value_group"
    )


def region_and_ownership(star: Star, minimum: int = 10) -> DataFrame:
    rating = F.col("overall_rating")
    return (
        star.spending()
        .join(
            hospitals(star, "state", "hospital_ownership", "overall_rating").where(
                rating.isNotNull()
            ),
            "facility_id",
        )
        .groupBy(
            census_region(F.col("state")).alias("census_region"),
            ownership_group(F.col("hospital_ownership")).alias("ownership_group"),
        )
        .agg(
            rows().alias("hospitals"),
            mean(ratio(), 3).alias("avg_mspb"),
            mean(rating, 2).alias("avg_star_rating"),
            percent(rows_where(rating >= 4), rows(), 1).alias("pct_4_or_5_star"),
        )
        .where((F.col("census_region") != "Territories") & (F.col("hospitals") >= minimum))
        .orderBy("census_region", "ownership_group")
    )


# --- geography --------------------------------------------------------------------------


def spending_by_state(star: Star, minimum: int = 10) -> DataFrame:
    return (
        star.spending()
        .join(hospitals(star, "state", "overall_rating"), "facility_id")
        .join(hf_readmissions(star, "score"), "facility_id", "left")
        .groupBy("state")
        .agg(
            rows().alias("hospitals"),
            mean(ratio(), 3).alias("avg_mspb"),
            mean(F.col("overall_rating"), 2).alias("avg_star_rating"),
            mean(F.col("score"), 2).alias("avg_hf_readmission_pct"),
            percent(rows_where(ratio() > 1), rows(), 1).alias("pct_above_natl_spend"),
        )
        .where(F.col("hospitals") >= minimum)
        .orderBy(F.desc_nulls_first("avg_mspb"), "state")
    )


def state_ranks(star: Star, minimum: int = 10) -> DataFrame:
    """Ranks on unrounded averages; a state without any rating ranks first.

    The windows see one row per two-letter state code, whatever the number of hospitals.
    """
    stats = (
        star.spending()
        .join(hospitals(star, "state", "overall_rating"), "facility_id")
        .groupBy("state")
        .agg(
            rows().alias("hospitals"),
            F.avg(ratio()).alias("avg_ratio"),
            F.avg(exact(F.col("overall_rating"))).alias("avg_stars"),
        )
        .where(F.col("hospitals") >= minimum)
    )
    by_stars = Window.orderBy(F.desc_nulls_first("avg_stars"))
    by_ratio = Window.orderBy(F.desc_nulls_first("avg_ratio"))
    return stats.select(
        "state",
        "hospitals",
        rounded(F.col("avg_stars"), 2).alias("avg_star_rating"),
        F.rank().over(by_stars).alias("star_rank"),
        rounded(F.col("avg_ratio"), 3).alias("avg_spending_ratio"),
        F.rank().over(by_ratio).alias("spending_rank"),
    ).orderBy("star_rank", "state")


def mortality_by_state(star: Star, spending_measure: str | None = SPENDING) -> DataFrame:
    """Hospitals are reduced to one row each first, so distinct hospitals are a plain count."""
    per_hospital = (
        star.spending(spending_measure)
        .groupBy("facility_id")
        .agg(rows().alias("n"), F.sum("mspb_ratio").alias("ratio_sum"))
        .join(hf_deaths(star, "score"), "facility_id")
        .join(hospitals(star, "state"), "facility_id")
    )
    # A hospital with two spending rows weighs twice in both averages.
    weight = F.col("n").cast("decimal(9,0)")
    whole, n = "decimal(28,10)", F.sum("n").cast("decimal(18,0)")
    return (
        per_hospital.groupBy("state")
        .agg(
            rounded(F.try_divide(F.sum(F.col("score") * weight).cast(whole), n), 2).alias(
                "avg_hf_mortality"
            ),
            rounded(F.try_divide(F.sum("ratio_sum").cast(whole), n), 4).alias(
                "avg_spending_ratio"
            ),
            rows().alias("n_hospitals"),
        )
        .orderBy("state")
    )


def for_profit_mix_by_state(star: Star, minimum: int = 10) -> DataFrame:
    for_profit = F.col("hospital_ownership").isin(FOR_PROFIT)
    return (
        star.spending()
        .join(hospitals(star, "state", "hospital_ownership", "overall_rating"), "facility_id")
        .groupBy("state")
        .agg(
            rows().alias("hospitals"),
            percent(rows_where(for_profit), rows(), 1).alias("pct_for_profit"),
            mean(ratio(), 3).alias("avg_mspb"),
            mean(F.col("overall_rating"), 2).alias("avg_star_rating"),
        )
        .where(F.col("hospitals") >= minimum)
        .orderBy(F.desc_nulls_first("pct_for_profit"), "state")
    )
