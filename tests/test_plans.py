"""Shape of the physical plans, with automatic broadcasts off: as if all tables were large."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from starward.plans import catalogue, star
from starward.sources.schemas import STAR_FIELDS

QUESTIONS = (
    catalogue.EXPLORATORY | catalogue.HEADLINE | catalogue.DASHBOARD | catalogue.STANDALONE
)
# Facts joined with each other or with hospitals, then grouped by something small.
FACT_JOINS = [
    "outcomes_by_spending_quartile",
    "top_rated_by_spending_level",
    "spread_within_states",
    "infections_by_spending_level",
    "better_or_worse_by_spending_level",
    "spending_by_survey_stars",
    "stars_and_spending_by_ownership",
    "region_and_ownership",
    "spending_by_state",
    "mortality_by_state",
    "for_profit_mix_by_state",
    "all_outcomes_by_spending_quartile",
    "spending_and_stars_by_state",
    "worse_mortality_by_ownership",
]


@pytest.fixture
def plan(sample_star, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")

    def of(name):
        df = QUESTIONS[name](sample_star)
        return df._jdf.queryExecution().executedPlan().toString().splitlines()

    return of


def depth(line):
    return len(line) - len(line.lstrip(" :+-*()0123456789"))


@pytest.mark.parametrize("name", QUESTIONS)
def test_no_cross_joins(plan, name):
    lines = plan(name)
    assert not [x for x in lines if "CartesianProduct" in x or "NestedLoopJoin" in x]


@pytest.mark.parametrize("name", QUESTIONS)
def test_a_single_task_sees_only_aggregates_or_offsets(plan, name):
    """Below every Exchange SinglePartition there is an aggregate before any scan."""
    lines = plan(name)
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = []
            for x in lines[i + 1 :]:
                if depth(x) <= depth(line):
                    break
                below.append(x)
            first_scan = next(
                j for j, x in enumerate(below) if "FileScan" in x or "ReusedExchange" in x
            )
            assert any("Aggregate" in x for x in below[:first_scan]), name


@pytest.mark.parametrize("name", FACT_JOINS)
def test_facts_are_joined_without_a_shuffle(plan, name):
    """All exchanges lie above the joins: they carry partial aggregates or the final sort."""
    lines = plan(name)
    first_join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    assert not [x for x in lines[first_join:] if "Exchange" in x]
    assert [x for x in lines if "Bucketed: true" in x]


def test_filters_and_columns_reach_the_scan(plan):
    scan = next(x for x in plan("top_readmission_states") if "fact_unplanned_visits" in x)
    assert "EqualTo(measure_id,READM_30_HF)" in scan
    assert "ReadSchema: struct<facility_id:string,measure_id:string,score:decimal(20,10)>" in scan


def test_top_k_is_not_a_full_sort(plan):
    for name in ("top_readmission_states", "first_hospitals"):
        assert any("TakeOrderedAndProject" in x for x in plan(name))
    assert any("WindowGroupLimit" in x for x in plan("best_value_hospitals"))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_the_audit_scans_every_table_once_and_shuffles_counts(sample_star, conf):
    conf("spark.sql.adaptive.enabled", "false")
    lines = executed(catalogue.QUESTIONS["audit_columns"](sample_star))
    scans = [x for x in lines if "FileScan" in x]
    audited = [t for t, fields in STAR_FIELDS.items() if any(f.kind != "text" for f in fields)]
    assert len(scans) == len(audited) == len({x.split("Location")[1] for x in scans})
    shuffles = [n for n, x in enumerate(lines) if "Exchange hashpartitioning(table_name" in x]
    assert len(shuffles) == 2 and all("partial_" in lines[n + 1] for n in shuffles)


def test_sketches_need_one_scan_and_one_small_shuffle(sample_star, conf):
    conf("spark.sql.adaptive.enabled", "false")
    lines = executed(catalogue.QUESTIONS["approximate_score_percentiles"](sample_star))
    assert len([x for x in lines if "FileScan" in x]) == 1
    shuffles = [n for n, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 1 and "partial_percentile_approx" in lines[shuffles[0] + 1]
    assert not [x for x in lines if "RunningCount" in x or "Join" in x]


def test_hot_unknown_ids_stay_in_place(spark, conf, monkeypatch):
    """Also when the unknown ids are too many to be broadcast."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    monkeypatch.setattr(star, "BROADCAST_BYTES", 100)
    known = spark.range(100).select(F.format_string("%06d", "id").alias("facility_id"))
    hot = spark.range(3000).select(F.lit("999999").alias("facility_id"))
    cold = spark.range(2000).select(F.format_string("8%05d", "id").alias("facility_id"))
    rows = known.union(hot).union(cold)
    left = star._drop_unknown(rows, known)
    assert left.where("facility_id = '999999'").count() == 0
    assert left.join(known, "facility_id", "left_semi").count() == 100
    assert left.count() == 2100
    plan = executed(left)
    assert "BroadcastHashJoin" in "".join(plan)
    assert not [x for x in plan if "Exchange hashpartitioning" in x]
