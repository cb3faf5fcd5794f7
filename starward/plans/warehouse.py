"""Where the star lives: versioned folders of Parquet, facts bucketed by facility.

Facts and ``dim_hospital`` are written in the same number of buckets on ``facility_id``, so
joins between them and groupings by facility need no shuffle at any size. Inside a bucket rows
are sorted by measure: a query for one measure skips the row groups of the others.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starward.functions.measures import SPENDING
from starward.operators.ordering import global_ntile
from starward.sources.schemas import FACTS, RAW_COLUMNS, STAR_FIELDS, raw_schema, star_schema
from starward.sources.shared import delete_folder, temporary_tables

BUCKETED = ["dim_hospital", *FACTS]
SORTED_BY = {
    "dim_hospital": ["facility_id"],
    **{fact: ["measure_id", "facility_id"] for fact in FACTS},
}
#: Stored bytes of the largest source in one bucket.
BYTES_PER_BUCKET = 128 << 20


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a stored table; reads no column."""
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.sum("file_size")).first()[0] or 0


def bucket_count(stored: int, cores: int) -> int:
    """As many buckets as the bytes ask for, and work for every core."""
    return max(cores, -(-stored // BYTES_PER_BUCKET))


def write_bucketed(df: DataFrame, path: str, name: str, buckets: int, sort_by: list[str]) -> None:
    """One task and one file per bucket."""
    (
        df.repartition(buckets, "facility_id")
        .write.format("parquet")
        .mode("overwrite")
        .bucketBy(buckets, "facility_id")
        .sortBy(*sort_by)
        .option("path", path)
        .saveAsTable(name)
    )


def open_bucketed(
    spark: SparkSession, path: str, name: str, buckets: int, sort_by: list[str], columns: str
) -> DataFrame:
    """The bucketed table at ``path``, declared in this session's catalog if it is not yet."""
    location = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY (facility_id) SORTED BY ({', '.join(sort_by)}) INTO {buckets} BUCKETS "
        f"LOCATION '{location}'"
    )
    return spark.table(name)


def _columns_ddl(table: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in star_schema(table))


def table_name(version: str, table: str) -> str:
    return f"starward_{version}_{table}"


@dataclass
class Star:
    """One version of the cleaned tables, with the raw text they were built from."""

    spark: SparkSession
    root: str
    version: str
    buckets: int
    tables: dict[str, DataFrame] = field(default_factory=dict)
    raw: dict[str, DataFrame] = field(default_factory=dict)
    _quartiles: DataFrame | None = None
    _csv: set[str] = field(default_factory=set)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]

    def path(self, table: str) -> str:
        return f"{self.root}/{self.version}/{table}"

    def open_raw(self, source: str) -> DataFrame:
        self.raw[source] = self.spark.read.schema(raw_schema(source)).parquet(
            self.path(f"raw_{source}")
        )
        return self.raw[source]

    def open_table(self, table: str) -> DataFrame:
        if table in BUCKETED:
            self.tables[table] = open_bucketed(
                self.spark,
                self.path(table),
                table_name(self.version, table),
                self.buckets,
                SORTED_BY[table],
                _columns_ddl(table),
            )
        else:
            self.tables[table] = self.spark.read.schema(star_schema(table)).parquet(
                self.path(table)
            )
        return self.tables[table]

    def stored_schema(self, table: str) -> T.StructType:
        """The types in the files, whatever the table declares."""
        return self.spark.read.parquet(self.path(table)).schema

    def csv_path(self, source: str) -> str:
        """The raw source as a CSV folder, written at the first call."""
        path = self.path(f"csv_{source}")
        with self._lock:
            if source not in self._csv:
                self.raw[source].write.options(header=True, escape='"').mode("overwrite").csv(path)
                self._csv.add(source)
        return path

    def discard(self) -> None:
        """Remove the version: its catalog entries and its folder."""
        for row in self.spark.sql(f"SHOW TABLES LIKE '{table_name(self.version, '*')}'").collect():
            self.spark.sql(f"DROP TABLE IF EXISTS {row.tableName}")
        delete_folder(self.spark, f"{self.root}/{self.version}")

    def write_raw(self, source: str, df: DataFrame) -> DataFrame:
        df.write.parquet(self.path(f"raw_{source}"))
        return self.open_raw(source)

    def write_table(self, table: str, df: DataFrame) -> DataFrame:
        if table in BUCKETED:
            name = table_name(self.version, table)
            write_bucketed(df, self.path(table), name, self.buckets, SORTED_BY[table])
        else:
            df.write.parquet(self.path(table))
        return self.open_table(table)

    def spending(self, measure: str | None = SPENDING) -> DataFrame:
        """(facility_id, mspb_ratio) of all scored rows; ``None`` takes every measure."""
        scored = self["fact_spending"].where(F.col("mspb_ratio").isNotNull())
        if measure is not None:
            scored = scored.where(F.col("measure_id") == measure)
        return scored.select("facility_id", "mspb_ratio")

    def spending_quartiles(self) -> DataFrame:
        """Quartile of every scored hospital, built once per version.

        ``ntile`` leaves the order of ties open; here the facility id decides.
        """
        with self._lock:
            if self._quartiles is None:
                label = f"spending_quartiles_{uuid.uuid4().hex[:8]}"
                name = table_name(self.version, label)
                with temporary_tables(self.spark):
                    tiles = global_ntile(
                        self.spending(), 4, "mspb_ratio", "facility_id", "quartile"
                    )
                    write_bucketed(tiles, self.path(label), name, self.buckets, ["facility_id"])
                self._quartiles = self.spark.table(name)
            return self._quartiles


def _published_path(root: str) -> str:
    return f"{root}/published"


def publish(star: Star) -> None:
    """Make a version current. One appended row: readers of the old version go on."""
    star.spark.range(1).select(
        F.lit(star.version).alias("version"),
        F.lit(star.buckets).alias("buckets"),
        F.current_timestamp().alias("published_at"),
    ).write.mode("append").parquet(_published_path(star.root))


def _published(spark: SparkSession, root: str) -> DataFrame:
    """The published versions, the newest first."""
    versions = spark.read.schema("version string, buckets int, published_at timestamp")
    return versions.parquet(_published_path(root)).orderBy(F.desc("published_at"))


def prune(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Remove all published versions but the newest ``keep``; gives the removed ones.

    Readers of a removed version lose it, so keep as many as may still be in use. The driver
    sees one short row per version.
    """
    root = root.rstrip("/")
    old = _published(spark, root).collect()[max(keep, 1) :]
    for row in old:
        Star(spark, root, row.version, row.buckets).discard()
    return [row.version for row in old]


def open_star(spark: SparkSession, root: str) -> Star:
    """The version published last under ``root``."""
    row = _published(spark, root).first()
    star = Star(spark, root, row["version"], row["buckets"])
    for source in RAW_COLUMNS:
        star.open_raw(source)
    for table in STAR_FIELDS:
        star.open_table(table)
    return star
