"""Hand-made raw sources: rows as dicts, every column not given is blank."""

from __future__ import annotations

from starward.plans.load import load
from starward.sources.schemas import RAW_COLUMNS, raw_schema

DATES = {"start_date": "07/01/2023", "end_date": "06/30/2024"}


def raws(spark, **sources):
    result = {}
    for source, columns in RAW_COLUMNS.items():
        rows = [tuple(row.get(c, "") for c in columns) for row in sources.get(source, [])]
        result[source] = spark.createDataFrame(rows, raw_schema(source)).coalesce(1)
    return result


def hospital(facility_id, state="TX", rating="3", **more):
    return {
        "facility_id": facility_id,
        "facility_name": f"Hospital {facility_id}",
        "state": state,
        "hospital_type": "Acute Care Hospitals",
        "hospital_ownership": "Proprietary",
        "hospital_overall_rating": rating,
        **more,
    }


def spending(facility_id, score, measure_id="MSPB-1", **more):
    return {
        "facility_id": facility_id,
        "measure_id": measure_id,
        "measure_name": "Spending",
        "score": score,
        **DATES,
        **more,
    }


def result(facility_id, measure_id, score="1.0", **more):
    return {
        "facility_id": facility_id,
        "measure_id": measure_id,
        "measure_name": f"Name of {measure_id}",
        "score": score,
        **DATES,
        **more,
    }


def survey(facility_id, measure_id="H_STAR_RATING", stars="3", **more):
    return {
        "facility_id": facility_id,
        "hcahps_measure_id": measure_id,
        "hcahps_question": f"Name of {measure_id}",
        "patient_survey_star_rating": stars,
        **DATES,
        **more,
    }


def small_star(spark, root, strict=True, buckets=2, **sources):
    return load(raws(spark, **sources), str(root), strict=strict, buckets=buckets)
