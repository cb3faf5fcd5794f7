"""The load job: stage the raw text, build the star, check it, publish it."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starward.functions.measures import rows
from starward.plans import star as build
from starward.plans.checks import CONSTRAINTS
from starward.plans.warehouse import Star, bucket_count, publish, stored_bytes
from starward.sources.csv_files import read_folder, source_paths
from starward.sources.schemas import DATASETS
from starward.sources.shared import run_together, temporary_tables


class LoadRejected(Exception):
    """The staged tables break a constraint; nothing was published."""


def load_log(star: Star, files: Mapping[str, str]) -> DataFrame:
    """One row per source: catalogue id, title, file, rows, time."""
    logged = [
        star.raw[d.source]
        .agg(rows().alias("n"))
        .select(
            F.lit(d.dataset_id).alias("dataset_id"),
            F.lit(d.title).alias("title"),
            F.lit(files.get(d.source, d.file_name)).alias("local_file"),
            F.col("n").alias("rows_loaded"),
            F.current_timestamp().alias("loaded_at"),
        )
        for d in DATASETS
    ]
    result = logged[0]
    for part in logged[1:]:
        result = result.unionByName(part)
    return result


def load(
    raws: Mapping[str, DataFrame],
    root: str,
    files: Mapping[str, str] | None = None,
    strict: bool = True,
    buckets: int | None = None,
) -> Star:
    """Always a full rebuild, into a new version folder.

    The raw text is staged first, so each source is parsed once and every later step reads
    only the columns it needs. The previous version stays current unless all checks pass; a
    version that is not published is removed.
    """
    spark = next(iter(raws.values())).sparkSession
    star = Star(spark, root.rstrip("/"), uuid.uuid4().hex[:12], buckets or 1)
    try:
        _build(star, raws, files or {}, strict, buckets)
    except Exception:
        star.discard()
        raise
    publish(star)
    return star


def _build(
    star: Star,
    raws: Mapping[str, DataFrame],
    files: Mapping[str, str],
    strict: bool,
    buckets: int | None,
) -> None:
    spark = star.spark
    run_together(lambda source: star.write_raw(source, raws[source]), raws)
    if buckets is None:
        largest = max(stored_bytes(df) for df in star.raw.values())
        star.buckets = bucket_count(largest, spark.sparkContext.defaultParallelism)

    dimensions = {
        "dim_hospital": lambda: build.dim_hospital(star.raw["hospital_info"]),
        "dim_measure": lambda: build.dim_measure(star.raw),
        "dim_period": lambda: build.dim_period(star.raw, strict),
        "load_log": lambda: load_log(star, files),
    }

    def write(table: str, build_table) -> None:
        with temporary_tables(spark):
            star.write_table(table, build_table())

    run_together(lambda table: write(table, dimensions[table]), dimensions)
    sources = {d.table: d.source for d in DATASETS}
    run_together(
        lambda fact: write(
            fact,
            lambda: build.FACT_BUILDERS[fact](
                star.raw[sources[fact]], star["dim_hospital"], star["dim_period"], strict
            ),
        ),
        build.FACT_BUILDERS,
    )

    # Bounded: one row per declared constraint.
    found = run_together(lambda check: check(star).collect(), CONSTRAINTS)
    broken = [row for part in found for row in part if row.violations]
    if broken:
        raise LoadRejected(
            "; ".join(
                f"{r.table_name}({r.column_names}): {r.check_name}, {r.violations}" for r in broken
            )
        )


def load_csv_folder(
    spark: SparkSession,
    folder: str,
    root: str,
    strict: bool = True,
    multi_line: bool = False,
    buckets: int | None = None,
) -> Star:
    """Load the six CSV files of ``folder``."""
    return load(
        read_folder(spark, folder, multi_line), root, source_paths(folder), strict, buckets
    )
