"""All named questions, and the star they run on for a folder of sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starward.operators.ordering import global_ranks
from starward.plans import checks, dashboard, explore, standalone
from starward.plans.load import load
from starward.plans.publish import publish_questions
from starward.plans.warehouse import Star
from starward.sources.csv_files import read_source
from starward.sources.sample_tables import raw_sources
from starward.sources.schemas import RAW_COLUMNS, STAR_TABLES
from starward.sources.shared import shared_folder

Question = Callable[[Star], DataFrame]

HEADLINE: dict[str, Question] = {
    "scored_hospitals": explore.scored_hospitals,
    "spending_star_correlation": explore.spending_star_correlation,
    "top_rated_share": explore.top_rated_share,
}

DASHBOARD: dict[str, Question] = {
    "outcomes_by_spending_quartile": dashboard.outcomes_by_spending_quartile,
    "top_rated_by_spending_level": dashboard.top_rated_by_spending_level,
    "spending_histogram": dashboard.spending_histogram,
    "star_rating_distributions": dashboard.star_rating_distributions,
    "hf_rate_distributions": dashboard.hf_rate_distributions,
    "infection_distribution": dashboard.infection_distribution,
    "metric_spread": dashboard.metric_spread,
    "readmission_spread_by_quartile": dashboard.readmission_spread_by_quartile,
    "spread_within_states": dashboard.spread_within_states,
    "spending_vs_readmission": dashboard.spending_vs_readmission,
    "spending_vs_mortality": dashboard.spending_vs_mortality,
    "infections_by_type_and_quartile": dashboard.infections_by_type_and_quartile,
    "infections_by_spending_level": dashboard.infections_by_spending_level,
    "better_or_worse_by_spending_level": dashboard.better_or_worse_by_spending_level,
    "spending_by_survey_stars": dashboard.spending_by_survey_stars,
    "survey_topic_gaps": dashboard.survey_topic_gaps,
    "recommendation_points": dashboard.recommendation_points,
    "stars_and_spending_by_ownership": dashboard.stars_and_spending_by_ownership,
    "value_groups_by_ownership": dashboard.value_groups_by_ownership,
    "region_and_ownership": dashboard.region_and_ownership,
    "spending_by_state": dashboard.spending_by_state,
    "state_ranks": dashboard.state_ranks,
    "mortality_by_state": dashboard.mortality_by_state,
    "for_profit_mix_by_state": dashboard.for_profit_mix_by_state,
}

EXPLORATORY: dict[str, Question] = {
    "table_rows": explore.table_rows,
    "measures_per_domain": explore.measures_per_domain,
    "hospitals_by_type_and_ownership": explore.hospitals_by_type_and_ownership,
    "star_distribution": explore.star_distribution,
    "spending_summary": explore.spending_summary,
    "spending_by_stars": explore.spending_by_stars,
    "survey_stars_by_spending_level": explore.survey_stars_by_spending_level,
    "worse_mortality_by_ownership": explore.worse_mortality_by_ownership,
    "infection_ratio_by_measure": explore.infection_ratio_by_measure,
    "approximate_score_percentiles": explore.approximate_score_percentiles,
    "spending_and_stars_by_state": explore.spending_and_stars_by_state,
    "top_readmission_states": explore.top_readmission_states,
    "periods_by_domain": explore.periods_by_domain,
    # A facility that exists at every scale of the sample tables.
    "spot_check": partial(explore.spot_check, facility_id="000001"),
}

STANDALONE: dict[str, Question] = {
    "spending_vs_readmission_with_correlation": (
        standalone.spending_vs_readmission_with_correlation
    ),
    "best_value_hospitals": standalone.best_value_hospitals,
    "for_profit_mix_with_correlation": standalone.for_profit_mix_with_correlation,
    "spending_vs_all_readmissions": standalone.spending_vs_all_readmissions,
    "all_outcomes_by_spending_quartile": standalone.all_outcomes_by_spending_quartile,
    "rows_per_spending_measure": standalone.rows_per_spending_measure,
    "measures_of_domain": standalone.measures_of_domain,
    "footnotes_of_measure": standalone.footnotes_of_measure,
    "state_spending_and_stars": standalone.state_spending_and_stars,
    "stars_and_spending_by_ownership_all_measures": partial(
        dashboard.stars_and_spending_by_ownership, spending_measure=None
    ),
    "top_rated_by_spending_level_all_measures": partial(
        dashboard.top_rated_by_spending_level, spending_measure=None
    ),
    "infections_by_spending_level_all_measures": partial(
        dashboard.infections_by_spending_level, spending_measure=None
    ),
    "readmission_by_spending_level_all_measures": partial(
        dashboard.readmission_by_spending_level, spending_measure=None
    ),
    "stars_by_state": standalone.stars_by_state,
    "state_spending": standalone.state_spending,
    "state_mortality": standalone.state_mortality,
    "spending_vs_mortality_all_measures": partial(
        dashboard.spending_vs_mortality, spending_measure=None
    ),
    "spending_by_survey_stars_all_measures": partial(
        dashboard.spending_by_survey_stars, spending_measure=None
    ),
    # The time of the load is left out: it differs from run to run.
    "load_log_listing": lambda star: standalone.load_log_listing(star).drop("loaded_at"),
    "star_distribution_labelled": explore.star_distribution_labelled,
    "spending_by_stars_labelled": explore.spending_by_stars_labelled,
    "first_hospitals": standalone.first_hospitals,
}


def _as_double(df: DataFrame) -> DataFrame:
    """Decimals as doubles, small integers as integers: the types results are compared in."""
    casts = {"decimal": "double", "smallint": "int"}
    return df.select(
        *[
            F.col(name).cast(casts.get(kind.split("(")[0], kind)).alias(name)
            for name, kind in df.dtypes
        ]
    )


def star_table(star: Star, table: str) -> DataFrame:
    return _as_double(star[table])


def scan_csv(star: Star, source: str) -> DataFrame:
    """The raw source, written as CSV once per star, scanned back."""
    return read_source(star.spark, source, star.csv_path(source))


def spending_quartiles(star: Star) -> DataFrame:
    return _as_double(star.spending_quartiles())


def spending_ranks(star: Star) -> DataFrame:
    """Rank and percent rank of every scored hospital by spending ratio."""
    return _as_double(global_ranks(star.spending(), "mspb_ratio", "spending_rank"))


def publish_dashboard(star: Star) -> DataFrame:
    """Materialise the 24 dashboard questions and 3 headline numbers, with their status."""
    folder = f"{shared_folder(star.spark)}/starward/dashboard-{uuid.uuid4().hex}"
    return publish_questions(star, HEADLINE | DASHBOARD, folder).drop("error")


LOADED: dict[str, Question] = {
    **{f"scan_{source}_csv": partial(scan_csv, source=source) for source in RAW_COLUMNS},
    **{table: partial(star_table, table=table) for table in STAR_TABLES},
    "check_loaded_rows": checks.loaded_rows,
    "check_missing_scores": checks.missing_scores,
    "audit_columns": checks.column_audit,
    "check_duplicate_keys": checks.duplicate_keys,
    "check_orphan_rows": checks.orphan_rows,
    "check_missing_required": checks.missing_required,
    "check_out_of_range": checks.out_of_range,
    "report_rejected_text": checks.rejected_text,
    "spending_quartiles": spending_quartiles,
    "spending_ranks": spending_ranks,
    "publish_dashboard": publish_dashboard,
}

QUESTIONS: dict[str, Question] = LOADED | EXPLORATORY | HEADLINE | DASHBOARD | STANDALONE

_stars: dict[tuple[str, str], Star] = {}


def star_for(spark: SparkSession, folder: str) -> Star:
    """The star of a folder of sample tables: loaded once per application, then reused."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _stars:
        root = f"{shared_folder(spark)}/starward/star-{uuid.uuid4().hex}"
        _stars[key] = load(raw_sources(spark, folder), root)
    return _stars[key]


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUESTIONS[name](star_for(spark, folder))
