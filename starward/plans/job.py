"""The job to submit: load a folder of CSV files, print the checks, publish the dashboard.

    spark-submit starward/plans/job.py CSV_FOLDER STAR_FOLDER RESULT_FOLDER
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from starward.plans import checks
from starward.plans.catalogue import DASHBOARD, EXPLORATORY, HEADLINE
from starward.plans.load import load_csv_folder
from starward.plans.publish import prune_results, publish_questions
from starward.plans.warehouse import prune


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Load, check and publish provider data.")
    parser.add_argument("csv", help="folder of the six source files")
    parser.add_argument("star", help="folder of the star, one subfolder per version")
    parser.add_argument("results", help="folder of the published questions")
    parser.add_argument("--tolerant", action="store_true", help="count bad text instead of stopping")
    parser.add_argument("--keep", type=int, default=2, help="versions of the star and of results that stay")
    chosen = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("starward load").getOrCreate()
    star = load_csv_folder(spark, chosen.csv, chosen.star, strict=not chosen.tolerant)
    for report in (checks.loaded_rows, checks.missing_scores, checks.column_audit, checks.rejected_text):
        report(star).show(1000, truncate=False)
    published = publish_questions(
        star, EXPLORATORY | HEADLINE | DASHBOARD, chosen.results, overwrite=True
    )
    published.show(1000, truncate=False)
    prune(spark, chosen.star, chosen.keep)
    prune_results(spark, chosen.results, chosen.keep)


if __name__ == "__main__":
    main()
