"""CSV scans: header skipped, columns by position, every column text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starward.sources.schemas import DATASETS, raw_schema


def read_source(
    spark: SparkSession, source: str, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """Scan one source.

    Rows with too few or too many fields stop the job. ``multi_line`` accepts line breaks
    inside quoted fields, at the price of files that cannot be split over tasks; without it
    such a row fails the field count instead of loading wrongly.
    """
    return (
        spark.read.schema(raw_schema(source))
        .options(header=True, escape='"', mode="FAILFAST", multiLine=multi_line)
        .csv(path)
    )


def source_paths(folder: str) -> dict[str, str]:
    return {d.source: f"{folder.rstrip('/')}/{d.file_name}" for d in DATASETS}


def read_folder(spark: SparkSession, folder: str, multi_line: bool = False) -> dict[str, DataFrame]:
    """All six sources from one folder, under their usual file names."""
    return {
        source: read_source(spark, source, path, multi_line)
        for source, path in source_paths(folder).items()
    }
