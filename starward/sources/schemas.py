"""Declared layouts: six raw text sources and the star tables built from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Column layouts of the source files and of the cleaned tables.
RAW_COLUMNS: dict[str, list[str]] = {
    "hospital_info": [
        "facility_id",
        "facility_name",
        "address",
        "city_town",
        "state",
        "zip_code",
        "county_parish",
        "telephone_number",
        "hospital_type",
        "hospital_ownership",
        "emergency_services",
        "meets_birthing_friendly",
        "hospital_overall_rating",
        "hospital_overall_rating_footnote",
        "mort_group_measure_count",
        "count_facility_mort_measures",
        "count_mort_better",
        "count_mort_no_different",
        "count_mort_worse",
        "mort_group_footnote",
        "safety_group_measure_count",
        "count_facility_safety_measures",
        "count_safety_better",
        "count_safety_no_different",
        "count_safety_worse",
        "safety_group_footnote",
        "readm_group_measure_count",
        "count_facility_readm_measures",
        "count_readm_better",
        "count_readm_no_different",
        "count_readm_worse",
        "readm_group_footnote",
        "pt_exp_group_measure_count",
        "count_facility_pt_exp_measures",
        "pt_exp_group_footnote",
        "te_group_measure_count",
        "count_facility_te_measures",
        "te_group_footnote",
    ],
    "complications": [
        "facility_id",
        "facility_name",
        "address",
        "city_town",
        "state",
        "zip_code",
        "county_parish",
        "telephone_number",
        "measure_id",
        "measure_name",
        "compared_to_national",
        "denominator",
        "score",
        "lower_estimate",
        "higher_estimate",
        "footnote",
        "start_date",
        "end_date",
    ],
    "infections": [
        "facility_id",
        "facility_name",
        "address",
        "city_town",
        "state",
        "zip_code",
        "county_parish",
        "telephone_number",
        "measure_id",
        "measure_name",
        "compared_to_national",
        "score",
        "footnote",
        "start_date",
        "end_date",
    ],
    "unplanned_visits": [
        "facility_id",
        "facility_name",
        "address",
        "city_town",
        "state",
        "zip_code",
        "county_parish",
        "telephone_number",
        "measure_id",
        "measure_name",
        "compared_to_national",
        "denominator",
        "score",
        "lower_estimate",
        "higher_estimate",
        "number_of_patients",
        "number_of_patients_returned",
        "footnote",
        "start_date",
        "end_date",
    ],
    "patient_survey": [
        "facility_id",
        "facility_name",
        "address",
        "city_town",
        "state",
        "zip_code",
        "county_parish",
        "telephone_number",
        "hcahps_measure_id",
        "hcahps_question",
        "hcahps_answer_description",
        "patient_survey_star_rating",
        "patient_survey_star_rating_footnote",
        "hcahps_answer_percent",
        "hcahps_answer_percent_footnote",
        "hcahps_linear_mean_value",
        "number_of_completed_surveys",
        "number_of_completed_surveys_footnote",
        "survey_response_rate_percent",
        "survey_response_rate_percent_footnote",
        "start_date",
        "end_date",
    ],
    "spending": [
        "facility_id",
        "facility_name",
        "address",
        "city_town",
        "state",
        "zip_code",
        "county_parish",
        "telephone_number",
        "measure_id",
        "measure_name",
        "score",
        "footnote",
        "start_date",
        "end_date",
    ],
}


def raw_schema(source: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS[source]])


@dataclass(frozen=True)
class Dataset:
    """One source file as the load log and the row-count check name it."""

    dataset_id: str
    title: str
    source: str
    file_name: str
    check_label: str
    table: str


# Catalogue ids, titles and file names.
DATASETS = [
    Dataset(
        "xubh-q36u",
        "Hospital General Information",
        "hospital_info",
        "Hospital_General_Information.csv",
        "hospital info",
        "dim_hospital",
    ),
    Dataset(
        "ynj2-r877",
        "Complications and Deaths - Hospital",
        "complications",
        "Complications_and_Deaths-Hospital.csv",
        "complications and deaths",
        "fact_complications_deaths",
    ),
    Dataset(
        "77hc-ibv8",
        "Healthcare Associated Infections - Hospital",
        "infections",
        "Healthcare_Associated_Infections-Hospital.csv",
        "infections",
        "fact_infections",
    ),
    Dataset(
        "632h-zaca",
        "Unplanned Hospital Visits - Hospital",
        "unplanned_visits",
        "Unplanned_Hospital_Visits-Hospital.csv",
        "unplanned visits",
        "fact_unplanned_visits",
    ),
    Dataset(
        "dgck-syfz",
        "Patient Survey (HCAHPS) - Hospital",
        "patient_survey",
        "HCAHPS-Hospital.csv",
        "patient survey",
        "fact_patient_survey",
    ),
    Dataset(
        "rrqw-56er",
        "Medicare Spending Per Beneficiary - Hospital",
        "spending",
        "Medicare_Hospital_Spending_Per_Patient-Hospital.csv",
        "spending",
        "fact_spending",
    ),
]

FACTS = [d.table for d in DATASETS if d.table.startswith("fact_")]
STAR_TABLES = ["dim_hospital", "dim_measure", "dim_period", *FACTS]


@dataclass(frozen=True)
class Field:
    """``kind`` is the declared SQL type name; ``numeric`` is stored as decimal(20,10)."""

    name: str
    kind: str = "text"
    required: bool = False


_FACT_KEY = [
    Field("facility_id", required=True),
    Field("measure_id", required=True),
    Field("period_id", "integer"),
]

# The cleaned tables, their declared types and required columns.
STAR_FIELDS: dict[str, list[Field]] = {
    "dim_hospital": [
        Field("facility_id", required=True),
        Field("facility_name", required=True),
        Field("address"),
        Field("city_town"),
        Field("state", "character", required=True),
        Field("zip_code"),
        Field("county_parish"),
        Field("telephone_number"),
        Field("hospital_type"),
        Field("hospital_ownership"),
        Field("emergency_services", "boolean"),
        Field("birthing_friendly", "boolean"),
        Field("overall_rating", "smallint"),
    ],
    "dim_measure": [
        Field("measure_id", required=True),
        Field("measure_name", required=True),
        Field("measure_detail"),
        Field("measure_domain", required=True),
    ],
    "dim_period": [
        Field("period_id", "integer", required=True),
        Field("start_date", "date", required=True),
        Field("end_date", "date", required=True),
    ],
    "fact_complications_deaths": [
        *_FACT_KEY,
        Field("compared_to_national"),
        Field("denominator", "numeric"),
        Field("score", "numeric"),
        Field("lower_estimate", "numeric"),
        Field("higher_estimate", "numeric"),
        Field("footnote"),
    ],
    "fact_infections": [
        *_FACT_KEY,
        Field("compared_to_national"),
        Field("score", "numeric"),
        Field("footnote"),
    ],
    "fact_unplanned_visits": [
        *_FACT_KEY,
        Field("compared_to_national"),
        Field("denominator", "numeric"),
        Field("score", "numeric"),
        Field("lower_estimate", "numeric"),
        Field("higher_estimate", "numeric"),
        Field("number_of_patients", "integer"),
        Field("number_of_patients_returned", "integer"),
        Field("footnote"),
    ],
    "fact_patient_survey": [
        *_FACT_KEY,
        Field("star_rating", "smallint"),
        Field("answer_percent", "numeric"),
        Field("linear_mean_value", "numeric"),
        Field("completed_surveys", "integer"),
        Field("response_rate_percent", "numeric"),
    ],
    "fact_spending": [
        *_FACT_KEY,
        Field("mspb_ratio", "numeric"),
        Field("footnote"),
    ],
    "load_log": [
        Field("dataset_id", required=True),
        Field("title"),
        Field("local_file"),
        Field("rows_loaded", "bigint"),
        Field("loaded_at", "timestamp without time zone"),
    ],
}

_SPARK_TYPES = {
    "text": T.StringType(),
    "character": T.StringType(),
    "boolean": T.BooleanType(),
    "smallint": T.ShortType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "numeric": T.DecimalType(20, 10),
    "date": T.DateType(),
    "timestamp without time zone": T.TimestampType(),
}


def star_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(f.name, _SPARK_TYPES[f.kind]) for f in STAR_FIELDS[table]])
