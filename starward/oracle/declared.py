"""What the sources and tables should look like, stated apart from the package's own layouts."""

from __future__ import annotations

# Catalogue id, title, source, label in the row check, table.
DATASETS = [
    ("xubh-q36u", "Hospital General Information", "hospital_info", "hospital info", "dim_hospital"),
    ("ynj2-r877", "Complications and Deaths - Hospital", "complications", "complications and deaths", "fact_complications_deaths"),
    ("77hc-ibv8", "Healthcare Associated Infections - Hospital", "infections", "infections", "fact_infections"),
    ("632h-zaca", "Unplanned Hospital Visits - Hospital", "unplanned_visits", "unplanned visits", "fact_unplanned_visits"),
    ("dgck-syfz", "Patient Survey (HCAHPS) - Hospital", "patient_survey", "patient survey", "fact_patient_survey"),
    ("rrqw-56er", "Medicare Spending Per Beneficiary - Hospital", "spending", "spending", "fact_spending"),
]

# Columns of the source files.
SOURCES = {
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

# Tables, and (column, type, required) of each.
TABLES = {
    "dim_hospital": [
        ("facility_id", "text", True),
        ("facility_name", "text", True),
        ("address", "text", False),
        ("city_town", "text", False),
        ("state", "character", True),
        ("zip_code", "text", False),
        ("county_parish", "text", False),
        ("telephone_number", "text", False),
        ("hospital_type", "text", False),
        ("hospital_ownership", "text", False),
        ("emergency_services", "boolean", False),
        ("birthing_friendly", "boolean", False),
        ("overall_rating", "smallint", False),
    ],
    "dim_measure": [
        ("measure_id", "text", True),
        ("measure_name", "text", True),
        ("measure_detail", "text", False),
        ("measure_domain", "text", True),
    ],
    "dim_period": [
        ("period_id", "integer", True),
        ("start_date", "date", True),
        ("end_date", "date", True),
    ],
    "fact_complications_deaths": [
        ("facility_id", "text", True),
        ("measure_id", "text", True),
        ("period_id", "integer", False),
        ("compared_to_national", "text", False),
        ("denominator", "numeric", False),
        ("score", "numeric", False),
        ("lower_estimate", "numeric", False),
        ("higher_estimate", "numeric", False),
        ("footnote", "text", False),
    ],
    "fact_infections": [
        ("facility_id", "text", True),
        ("measure_id", "text", True),
        ("period_id", "integer", False),
        ("compared_to_national", "text", False),
        ("score", "numeric", False),
        ("footnote", "text", False),
    ],
    "fact_unplanned_visits": [
        ("facility_id", "text", True),
        ("measure_id", "text", True),
        ("period_id", "integer", False),
        ("compared_to_national", "text", False),
        ("denominator", "numeric", False),
        ("score", "numeric", False),
        ("lower_estimate", "numeric", False),
        ("higher_estimate", "numeric", False),
        ("number_of_patients", "integer", False),
        ("number_of_patients_returned", "integer", False),
        ("footnote", "text", False),
    ],
    "fact_patient_survey": [
        ("facility_id", "text", True),
        ("measure_id", "text", True),
        ("period_id", "integer", False),
        ("star_rating", "smallint", False),
        ("answer_percent", "numeric", False),
        ("linear_mean_value", "numeric", False),
        ("completed_surveys", "integer", False),
        ("response_rate_percent", "numeric", False),
    ],
    "fact_spending": [
        ("facility_id", "text", True),
        ("measure_id", "text", True),
        ("period_id", "integer", False),
        ("mspb_ratio", "numeric", False),
        ("footnote", "text", False),
    ],
    "load_log": [
        ("dataset_id", "text", True),
        ("title", "text", False),
        ("local_file", "text", False),
        ("rows_loaded", "bigint", False),
        ("loaded_at", "timestamp without time zone", False),
    ],
}
STAR = [name for name in TABLES if name != "load_log"]
