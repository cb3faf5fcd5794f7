from __future__ import annotations

import datetime

import pytest
import small
from conftest import SAMPLES
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starward.plans import checks, explore
from starward.plans.catalogue import scan_csv
from starward.plans.load import LoadRejected, load, load_csv_folder, load_log
from starward.plans.warehouse import BYTES_PER_BUCKET, bucket_count, open_star, prune, stored_bytes, table_name
from starward.sources.csv_files import source_paths
from starward.sources.sample_tables import raw_sources
from starward.sources.schemas import DATASETS, FACTS, STAR_FIELDS, STAR_TABLES, star_schema
from starward.sources.shared import shared_folder


def counts(df, key, value):
    return {row[key]: row[value] for row in df.collect()}


def test_schemas_are_the_declared_ones(sample_star):
    for table in [*STAR_TABLES, "load_log"]:
        found = [(f.name, f.dataType) for f in sample_star[table].schema]
        assert found == [(f.name, f.dataType) for f in star_schema(table)]


def test_unknown_hospitals_are_dropped_and_counted(sample_star):
    found = checks.loaded_rows(sample_star).collect()
    rows = {r.source: (r.raw_rows, r.loaded_rows) for r in found}
    assert rows.pop("complications and deaths") == (645, 644)
    assert all(raw == loaded for raw, loaded in rows.values())


def test_rows_without_dates_have_no_period(sample_star):
    by_period = sample_star["fact_spending"].groupBy("measure_id").agg(
        F.count("period_id").alias("dated"), F.count("*").alias("n")
    )
    rows = {r.measure_id: (r.dated, r.n) for r in by_period.collect()}
    assert rows["MSPB-ALT"][0] == 0
    assert rows["MSPB-1"][0] == rows["MSPB-1"][1]


def test_periods_are_numbered_in_date_order(sample_star):
    periods = sample_star["dim_period"].orderBy("period_id").collect()
    assert [p.period_id for p in periods] == [1, 2, 3]
    dates = [(p.start_date, p.end_date) for p in periods]
    assert dates == sorted(dates)
    assert dates[0] == (datetime.date(2021, 7, 1), datetime.date(2024, 6, 30))


def test_one_measure_row_takes_the_smallest_name(spark, tmp_path):
    star = small.small_star(
        spark,
        tmp_path,
        hospital_info=[small.hospital("1"), small.hospital("2")],
        infections=[
            small.result("1", "HAI_1_SIR", measure_name="b"),
            small.result("2", "HAI_1_SIR", measure_name="B"),
        ],
    )
    (measure,) = star["dim_measure"].collect()
    assert (measure.measure_name, measure.measure_detail) == ("B", None)
    assert measure.measure_domain == "Infections"


VIOLATIONS = {
    "duplicate hospital after padding": (
        {"hospital_info": [small.hospital("10001"), small.hospital("010001")]},
        r"dim_hospital\(facility_id\): duplicate key, 1",
    ),
    "duplicate fact": (
        {
            "hospital_info": [small.hospital("1")],
            "spending": [small.spending("1", "1.0"), small.spending("000001", "1.1")],
        },
        r"fact_spending\(facility_id, measure_id\): duplicate key, 1",
    ),
    "measure in two sources": (
        {
            "hospital_info": [small.hospital("1")],
            "infections": [small.result("1", "X")],
            "complications": [small.result("1", "X")],
        },
        r"dim_measure\(measure_id\): duplicate key, 1",
    ),
    "hospital without a name": (
        {"hospital_info": [small.hospital("1", facility_name=None)]},
        r"dim_hospital\(facility_name\): required value missing, 1",
    ),
    "state too long": (
        {"hospital_info": [small.hospital("1", state="TEX")]},
        r"dim_hospital\(state\): text too long, 1",
    ),
}


@pytest.mark.parametrize("case", VIOLATIONS)
def test_broken_constraints_stop_the_load(spark, tmp_path, case):
    sources, message = VIOLATIONS[case]
    with pytest.raises(LoadRejected, match=message):
        small.small_star(spark, tmp_path, **sources)
    assert not (tmp_path / "published").exists()


def test_checks_find_orphans_and_ratings(sample_star, spark):
    """The build cannot produce these, so the tables are broken by hand."""
    broken = sample_star.tables.copy()
    fact = sample_star["fact_spending"]
    broken["fact_spending"] = fact.withColumns(
        {
            "facility_id": F.when(F.col("facility_id") == "000003", "999998").otherwise(
                F.col("facility_id")
            ),
            "period_id": F.lit(77),
        }
    )
    broken["fact_patient_survey"] = sample_star["fact_patient_survey"].withColumn(
        "star_rating", F.lit(6).cast("smallint")
    )
    star = type(sample_star)(spark, "", "", 1, broken, sample_star.raw)
    orphans = checks.orphan_rows(star).where("table_name = 'fact_spending'")
    found = counts(orphans, "column_names", "violations")
    assert found == {
        "facility_id": fact.where("facility_id = '000003'").count(),
        "measure_id": 0,
        "period_id": fact.count(),
    }
    ratings = counts(checks.out_of_range(star), "table_name", "violations")
    assert ratings["fact_patient_survey"] == sample_star["fact_patient_survey"].count()


def test_strict_load_stops_on_unusable_text_and_tolerant_load_reports_it(spark, tmp_path):
    sources = {
        "hospital_info": [small.hospital("1"), small.hospital("2", rating="9")],
        "spending": [small.spending("1", "1.2.3"), small.spending("2", "0.9")],
        "patient_survey": [small.survey("1", number_of_completed_surveys="99999999999")],
    }
    with pytest.raises(Exception, match="not a valid"):
        small.small_star(spark, tmp_path, **sources)
    star = small.small_star(spark, tmp_path, strict=False, **sources)
    assert explore.spending_summary(star).first().hospitals_with_score == 1
    rejected = checks.rejected_text(star).where("rejected_values > 0").collect()
    assert {(r.source, r.column_name, r.rejected_values) for r in rejected} == {
        ("hospital_info", "hospital_overall_rating", 1),
        ("spending", "score", 1),
        ("patient_survey", "number_of_completed_surveys", 1),
    }


def test_text_of_an_unknown_hospital_stops_nothing(spark, tmp_path):
    star = small.small_star(
        spark,
        tmp_path,
        hospital_info=[small.hospital("1")],
        spending=[small.spending("1", "0.9"), small.spending("2", "1.2.3")],
    )
    assert [r.facility_id for r in star["fact_spending"].collect()] == ["000001"]


def test_a_rejected_load_leaves_the_old_version_current(spark, tmp_path):
    good = small.small_star(spark, tmp_path, hospital_info=[small.hospital("1")])
    with pytest.raises(LoadRejected):
        small.small_star(spark, tmp_path, hospital_info=[small.hospital("1", state="TEX")])
    assert open_star(spark, str(tmp_path)).version == good.version
    newer = small.small_star(spark, tmp_path, hospital_info=[small.hospital("2")])
    assert open_star(spark, str(tmp_path)).version == newer.version
    assert [r.facility_id for r in good["dim_hospital"].collect()] == ["000001"]


def test_star_opened_from_its_folder_is_still_bucketed(spark, sample_star):
    for table in ("fact_spending", "fact_unplanned_visits"):
        spark.sql(f"DROP TABLE {table_name(sample_star.version, table)}")
    star = open_star(spark, sample_star.root)
    sample_star.tables.update(star.tables)
    assert star.buckets == 3
    grouped = star["fact_spending"].groupBy("facility_id").count()
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    assert grouped.count() == star["fact_spending"].select("facility_id").distinct().count()


def test_load_from_csv_files(spark, sample_star, tmp_path):
    paths = source_paths(str(tmp_path / "csv"))
    for source, path in paths.items():
        sample_star.raw[source].write.options(header=True, escape='"').csv(path)
    star = load_csv_folder(spark, str(tmp_path / "csv"), str(tmp_path / "star"))
    for table in STAR_TABLES:
        assert star[table].exceptAll(sample_star[table]).count() == 0
        assert sample_star[table].exceptAll(star[table]).count() == 0
    log = {r.dataset_id: r for r in star["load_log"].collect()}
    assert log["rrqw-56er"].rows_loaded == sample_star.raw["spending"].count()
    assert log["rrqw-56er"].local_file == paths["spending"]
    assert all(r.loaded_at is not None for r in log.values())


def test_audit_lists_every_typed_column_in_order(sample_star):
    audit = checks.column_audit(sample_star).collect()
    found = [(r.table_name, r.column_name, r.data_type) for r in audit]
    expected = [
        (table, f.name, f.kind)
        for table in sorted(STAR_FIELDS)
        for f in STAR_FIELDS[table]
        if f.kind != "text"
    ]
    assert found == expected


def test_bucket_count_follows_the_bytes_and_the_cores():
    assert bucket_count(0, 8) == bucket_count(8 * BYTES_PER_BUCKET, 8) == 8
    assert bucket_count(8 * BYTES_PER_BUCKET + 1, 8) == 9
    assert bucket_count(100 * 10**12, 8) > 700_000


def test_the_load_uses_all_cores(spark, tmp_path):
    star = load(raw_sources(spark, str(SAMPLES / "sf0.001")), str(tmp_path))
    assert star.buckets == spark.sparkContext.defaultParallelism
    assert stored_bytes(star.raw["spending"]) > 0


def test_a_wrong_stored_type_turns_the_audit_red(spark, sample_star, tmp_path):
    class Wrong:
        def __getitem__(self, table):
            return sample_star[table]

        def stored_schema(self, table):
            schema = sample_star.stored_schema(table)
            if table == "dim_hospital":
                schema["state"].dataType = T.IntegerType()
                schema["overall_rating"].dataType = T.DoubleType()
            return schema

    found = {(r.table_name, r.column_name): r.data_type for r in checks.column_audit(Wrong()).collect()}
    assert found["dim_hospital", "state"] == "integer"
    assert found["dim_hospital", "overall_rating"] == "double"


def test_row_counts_beyond_32_bits(spark):
    class Counted:
        def agg(self, *_):
            return spark.range(1).select(F.lit(3_000_000_000).alias("n"))

    class Big:
        raw = {d.source: Counted() for d in DATASETS}

    log = load_log(Big(), {})
    assert log.schema["rows_loaded"].dataType == star_schema("load_log")["rows_loaded"].dataType
    assert {r.rows_loaded for r in log.collect()} == {3_000_000_000}


def test_ids_of_seven_digits_stay_apart(spark, tmp_path):
    raws = raw_sources(spark, str(SAMPLES / "sf0.001"))

    def longer(df):
        bare = F.regexp_replace("facility_id", "^0+", "")
        ids = F.when(bare == "1", "150000").when(bare == "2", "1500000").otherwise(F.col("facility_id"))
        return df.withColumn("facility_id", ids)

    before = load(raws, str(tmp_path / "a"))
    after = load({name: longer(df) for name, df in raws.items()}, str(tmp_path / "b"))
    for table in ("dim_hospital", *FACTS):
        for old, new in (("000001", "150000"), ("000002", "1500000")):
            rows = after[table].where(F.col("facility_id") == new).count()
            assert rows == before[table].where(F.col("facility_id") == old).count()
        assert after[table].count() == before[table].count()


def test_versions_go(spark, tmp_path):
    raws, root = raw_sources(spark, str(SAMPLES / "sf0.001")), tmp_path / "star"
    stars = [load(raws, str(root), buckets=2) for _ in range(3)]
    broken = dict(raws, hospital_info=raws["hospital_info"].union(raws["hospital_info"]))
    with pytest.raises(LoadRejected):
        load(broken, str(root), buckets=2)
    assert {p.name for p in root.iterdir()} == {"published", *(s.version for s in stars)}
    assert prune(spark, str(root), 2) == [stars[0].version]
    assert {p.name for p in root.iterdir()} == {"published", *(s.version for s in stars[1:])}
    assert open_star(spark, str(root)).version == stars[2].version
    names = [r.tableName for r in spark.sql("SHOW TABLES").collect()]
    assert not any(stars[0].version in name for name in names)


def test_the_raw_csv_is_written_once(sample_star):
    assert sample_star.csv_path("spending") == sample_star.csv_path("spending")
    first = scan_csv(sample_star, "spending").inputFiles()
    assert scan_csv(sample_star, "spending").inputFiles() == first


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
