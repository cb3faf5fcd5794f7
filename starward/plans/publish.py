"""Materialise named questions for a dashboard to read."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from starward.plans.warehouse import Star
from starward.sources.shared import delete_folder, run_together, temporary_tables

_POINTER = "version string, row_count bigint, published_at timestamp"


def _current(spark: SparkSession, folder: str, name: str) -> Row | None:
    """The version of a result published last, if there is one."""
    try:
        versions = spark.read.schema(_POINTER).parquet(f"{folder.rstrip('/')}/{name}/published")
        return versions.orderBy(F.desc("published_at")).first()
    except AnalysisException:
        return None


def published_result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The result of a question as published last; later versions do not disturb its readers."""
    row = _current(spark, folder, name)
    if row is None:
        raise LookupError(f"no published result: {name}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}/{row.version}")


def publish_questions(
    star: Star,
    questions: Mapping[str, Callable[[Star], DataFrame]],
    folder: str,
    overwrite: bool = False,
) -> DataFrame:
    """Run each question once and publish its result under ``folder/name``.

    Gives one row per question: created, updated, kept (already there, not overwritten) or
    failed, with the rows stored. A result is written to a folder of its own and counts only once
    a row that points at it has been appended, so what an interrupted or failed run leaves is
    never taken for a result and readers keep theirs. A question that fails is recorded and does
    not stop the rest; what it had stored goes. Intermediate tables of a question go when its
    result is stored. ``prune_results`` removes what later versions have replaced.
    """
    spark = star.spark

    def materialise(name: str) -> tuple:
        try:
            before = _current(spark, folder, name)
            if before is not None and not overwrite:
                return name, "kept", before.row_count, None
            place, version = f"{folder.rstrip('/')}/{name}", uuid.uuid4().hex[:12]
            try:
                with temporary_tables(spark):
                    questions[name](star).write.parquet(f"{place}/{version}")
                stored = spark.read.schema("_ string").parquet(f"{place}/{version}").count()
                spark.range(1).select(
                    F.lit(version).alias("version"),
                    F.lit(stored).cast("bigint").alias("row_count"),
                    F.current_timestamp().alias("published_at"),
                ).write.mode("append").parquet(f"{place}/published")
            except Exception:
                delete_folder(spark, f"{place}/{version}")
                raise
            return name, "created" if before is None else "updated", stored, None
        except Exception as error:  # whatever went wrong belongs to this question
            return name, "failed", None, str(error).splitlines()[0]

    return spark.createDataFrame(
        run_together(materialise, questions),
        "name string, status string, row_count bigint, error string",
    )


def _folders(spark: SparkSession, path: str) -> dict[str, float]:
    """Folders right below ``path``: name to seconds since their last change."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(place) if files.exists(place) else []
    now = time.time()
    return {
        f.getPath().getName(): now - f.getModificationTime() / 1000
        for f in found
        if f.isDirectory()
    }


def prune_results(
    spark: SparkSession, folder: str, keep: int = 2, unfinished_hours: float = 24
) -> dict[str, list[str]]:
    """Remove stored results but the newest ``keep`` of every question; gives the removed ones.

    Folders that no pointer names are left of runs that were killed, or belong to runs that go on:
    they are removed once nothing in them has changed for ``unfinished_hours``. Readers of a
    removed version lose it, so keep as many as may still be in use. The driver sees one short
    row per version of a question.
    """
    folder = folder.rstrip("/")

    def prune(name: str) -> tuple[str, list[str]]:
        place = f"{folder}/{name}"
        there = _folders(spark, place)
        if "published" not in there:
            kept, known = [], []
        else:
            versions = spark.read.schema(_POINTER).parquet(f"{place}/published")
            known = [row.version for row in versions.orderBy(F.desc("published_at")).collect()]
            kept = [version for version in known if version in there][: max(keep, 1)]
        removed = []
        for version, idle in there.items():
            replaced = version in known and version not in kept
            unfinished = version not in known and idle > unfinished_hours * 3600
            if version != "published" and (replaced or unfinished):
                delete_folder(spark, f"{place}/{version}")
                removed.append(version)
        return name, sorted(removed)

    return dict(run_together(prune, _folders(spark, folder)))
