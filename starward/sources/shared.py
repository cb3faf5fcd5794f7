"""Tables in the folder every executor can reach, and jobs submitted side by side."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may go without: it gets a temporary folder. A cluster without the
    setting is an error, since a folder of one machine would lose data with that machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="starward-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store it is; none there is fine."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_scope = threading.local()


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """What ``write_shared`` writes in this thread meanwhile goes at the end.

    For work whose result is stored elsewhere by then: DataFrames over the tables end with them.
    """
    outer, _scope.made = getattr(_scope, "made", None), []
    try:
        yield
    finally:
        made, _scope.made = _scope.made, outer
        for path in made:
            delete_folder(spark, path)


def write_shared(df: DataFrame, label: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Materialise once: later reads see the same rows and survive the loss of executors.

    ``partition_by`` names columns a reader filters by: one folder per value.
    """
    path = f"{shared_folder(df.sparkSession)}/starward/{label}-{uuid.uuid4().hex}"
    if (made := getattr(_scope, "made", None)) is not None:
        made.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_result(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``build`` gives, written once; the tables that it wrote on the way go.

    Of work that leaves many large tables for one small result, only that stays.
    """
    outer = getattr(_scope, "made", None)
    with temporary_tables(spark):
        result = build()
        made, _scope.made = _scope.made, outer
        try:
            return write_shared(result, label)
        finally:
            _scope.made = made


def run_together(job: Callable, items: Iterable) -> list:
    """Submit independent Spark jobs side by side, so that a small one does not hold up the rest."""
    with ThreadPoolExecutor(max_workers=6) as pool:
        return list(pool.map(job, items))
