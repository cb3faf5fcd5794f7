"""Load checks: row counts, missing values, keys, references, ranges, rejected text.

The constraint checks return one row per constraint with the number of violations, so a
clean load has zeros and the load job can add them up before it publishes anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starward.functions import cleaning as clean
from starward.functions.measures import rows, rows_where
from starward.plans.warehouse import Star
from starward.sources.schemas import DATASETS, FACTS, STAR_FIELDS

# Declared keys, rating columns and text widths.
KEYS = [
    ("dim_hospital", ["facility_id"]),
    ("dim_measure", ["measure_id"]),
    ("dim_period", ["period_id"]),
    ("dim_period", ["start_date", "end_date"]),
    *[(fact, ["facility_id", "measure_id"]) for fact in FACTS],
    ("load_log", ["dataset_id"]),
]
RATINGS = [("dim_hospital", "overall_rating"), ("fact_patient_survey", "star_rating")]
WIDTHS = [("dim_hospital", "state", 2)]
UNSCORED = {
    "fact_complications_deaths": ("complications and deaths", "score"),
    "fact_infections": ("infections", "score"),
    "fact_unplanned_visits": ("unplanned visits", "score"),
    "fact_spending": ("spending", "mspb_ratio"),
}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def loaded_rows(star: Star) -> DataFrame:
    """Rows in each raw source and in the table loaded from it."""
    return _union(
        [
            star.raw[d.source]
            .agg(rows().alias("raw_rows"))
            .select(
                F.lit(d.check_label).alias("source"),
                "raw_rows",
                star[d.table].agg(rows()).scalar().alias("loaded_rows"),
            )
            for d in DATASETS
        ]
    )


def missing_scores(star: Star) -> DataFrame:
    return _union(
        [
            star[table]
            .agg(
                rows().alias("total_rows"),
                rows_where(F.col(score).isNull()).alias("rows_without_score"),
            )
            .select(F.lit(label).alias("fact_table"), "total_rows", "rows_without_score")
            for table, (label, score) in UNSCORED.items()
        ]
    )


def _one_row_each(df: DataFrame, structs: list[Column]) -> DataFrame:
    """Aggregate a table once and turn the single result row into one row per struct."""
    return df.agg(F.array(*structs).alias("r")).select(F.inline("r"))


# SQL names of the stored types.
SQL_NAMES = {
    "string": "text",
    "boolean": "boolean",
    "smallint": "smallint",
    "int": "integer",
    "bigint": "bigint",
    "decimal(20,10)": "numeric",
    "date": "date",
    "timestamp": "timestamp without time zone",
}


def _stored_type(stored: T.DataType, declared: str) -> str:
    """The SQL name of a stored type. Text of declared width is stored as text."""
    name = SQL_NAMES.get(stored.simpleString(), stored.simpleString())
    return declared if (name, declared) == ("text", "character") else name


def _as_text(name: str, kind: str) -> Column:
    """A value as text, different values as different texts (a local time may occur twice)."""
    value = F.unix_micros(name) if kind == "timestamp without time zone" else F.col(name)
    return value.cast("string")


def column_audit(star: Star) -> DataFrame:
    """Stored type, NULLs and distinct values of every column that is not plain text.

    The types are those of the files. Every table is scanned once: a row becomes one
    (column, value) per audited column, equal ones are counted before they move, and one shuffle
    brings the counts of all tables together.
    """
    declared, parts = [], []
    for table, fields in STAR_FIELDS.items():
        stored = star.stored_schema(table)
        audited = [(n, f) for n, f in enumerate(fields, 1) if f.kind != "text"]
        if not audited:
            continue
        declared += [
            (table, n, f.name, _stored_type(stored[f.name].dataType, f.kind)) for n, f in audited
        ]
        values = F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("ordinal_position"), _as_text(f.name, f.kind).alias("v"))
                    for n, f in audited
                ]
            )
        )
        parts.append(
            star[table].select(values.alias("c")).select(F.lit(table).alias("table_name"), "c.*")
        )
    column = ["table_name", "ordinal_position"]
    counted = (
        _union(parts)
        .groupBy(*column, "v")
        .agg(rows().alias("n"))
        .groupBy(*column)
        .agg(
            F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("null_rows"),
            F.count("v").alias("distinct_values"),
        )
    )
    # One row per declared column: an empty table has zeros.
    every = counted.sparkSession.createDataFrame(
        declared, "table_name string, ordinal_position int, column_name string, data_type string"
    )
    zero = F.lit(0).cast("bigint")
    return (
        every.join(counted, column, "left")
        .select(
            *every.columns,
            F.coalesce("null_rows", zero).alias("null_rows"),
            F.coalesce("distinct_values", zero).alias("distinct_values"),
        )
        .orderBy(*column)
    )


def _violations(df: DataFrame, check: str, table: str, columns: str, count: Column) -> DataFrame:
    return df.agg(count.alias("violations")).select(
        F.lit(check).alias("check_name"),
        F.lit(table).alias("table_name"),
        F.lit(columns).alias("column_names"),
        "violations",
    )


def duplicate_keys(star: Star) -> DataFrame:
    """Number of key values that occur more than once."""
    return _union(
        [
            _violations(
                star[table].groupBy(*key).agg(rows().alias("n")).where(F.col("n") > 1),
                "duplicate key",
                table,
                ", ".join(key),
                rows(),
            )
            for table, key in KEYS
        ]
    )


def orphan_rows(star: Star) -> DataFrame:
    """Fact rows whose hospital, measure or period is not in the dimension.

    Hospitals are compared bucket by bucket. For the other two, rows are counted per (measure,
    period) first, so the lookups see each pair once. A NULL period is allowed.
    """
    hospitals = star["dim_hospital"].select("facility_id")
    measures = star["dim_measure"].select("measure_id", F.lit(True).alias("has_measure"))
    periods = star["dim_period"].select("period_id", F.lit(True).alias("has_period"))
    n = F.col("n")
    parts = []
    for fact in FACTS:
        parts.append(
            _violations(
                star[fact].join(hospitals, "facility_id", "left_anti"),
                "not in dim_hospital",
                fact,
                "facility_id",
                rows(),
            )
        )
        used = star[fact].groupBy("measure_id", "period_id").agg(rows().alias("n"))
        no_measure = F.col("has_measure").isNull() & F.col("measure_id").isNotNull()
        no_period = F.col("has_period").isNull() & F.col("period_id").isNotNull()
        parts.append(
            _one_row_each(
                used.join(measures, "measure_id", "left").join(periods, "period_id", "left"),
                [
                    F.struct(
                        F.lit(f"not in {parent}").alias("check_name"),
                        F.lit(fact).alias("table_name"),
                        F.lit(key).alias("column_names"),
                        F.coalesce(F.sum(F.when(missing, n)), F.lit(0)).alias("violations"),
                    )
                    for parent, key, missing in [
                        ("dim_measure", "measure_id", no_measure),
                        ("dim_period", "period_id", no_period),
                    ]
                ],
            )
        )
    return _union(parts)


def value_checks(star: Star) -> DataFrame:
    """Required values, ranges and widths, one aggregate per table."""
    parts = []
    for table, fields in STAR_FIELDS.items():
        counts = [
            ("required value missing", f.name, F.col(f.name).isNull()) for f in fields if f.required
        ]
        counts += [
            ("rating out of range", column, ~F.col(column).between(1, 5))
            for rated, column in RATINGS
            if rated == table
        ]
        counts += [
            ("text too long", column, F.length(column) > width)
            for wide, column, width in WIDTHS
            if wide == table
        ]
        structs = [
            F.struct(
                F.lit(check).alias("check_name"),
                F.lit(table).alias("table_name"),
                F.lit(column).alias("column_names"),
                rows_where(broken).alias("violations"),
            )
            for check, column, broken in counts
        ]
        parts.append(_one_row_each(star[table], structs))
    return _union(parts)


def missing_required(star: Star) -> DataFrame:
    """NULLs in columns that must have a value."""
    return value_checks(star).where(F.col("check_name") == "required value missing")


def out_of_range(star: Star) -> DataFrame:
    """Ratings outside 1..5 and texts wider than declared."""
    return value_checks(star).where(F.col("check_name") != "required value missing")


# The load is published when all of these count zero.
CONSTRAINTS = [duplicate_keys, orphan_rows, value_checks]


# Which raw columns are converted, and to what.
CONVERTED = {
    "hospital_info": {clean.stars_rejected: "hospital_overall_rating"},
    "complications": {
        clean.number_rejected: "denominator score lower_estimate higher_estimate",
        clean.date_rejected: "start_date end_date",
    },
    "infections": {clean.number_rejected: "score", clean.date_rejected: "start_date end_date"},
    "unplanned_visits": {
        clean.number_rejected: "denominator score lower_estimate higher_estimate",
        clean.count_rejected: "number_of_patients number_of_patients_returned",
        clean.date_rejected: "start_date end_date",
    },
    "patient_survey": {
        clean.stars_rejected: "patient_survey_star_rating",
        clean.number_rejected: (
            "hcahps_answer_percent hcahps_linear_mean_value survey_response_rate_percent"
        ),
        clean.count_rejected: "number_of_completed_surveys",
        clean.date_rejected: "start_date end_date",
    },
    "spending": {clean.number_rejected: "score", clean.date_rejected: "start_date end_date"},
}


def rejected_text(star: Star) -> DataFrame:
    """Per source and column: values that are neither usable nor a known 'no value' text.

    Cleaning turns such values into NULL (too long ids stay as they are); this says how many.
    """
    parts = []
    for source, tests in CONVERTED.items():
        flags = {"facility_id": clean.id_rejected(F.col("facility_id"))}
        for rejected, columns in tests.items():
            flags |= {c: rejected(F.col(c)) for c in columns.split()}
        parts.append(
            _one_row_each(
                star.raw[source],
                [
                    F.struct(
                        F.lit(source).alias("source"),
                        F.lit(column).alias("column_name"),
                        rows_where(flag).alias("rejected_values"),
                    )
                    for column, flag in flags.items()
                ],
            )
        )
    return _union(parts)
