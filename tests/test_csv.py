from __future__ import annotations

import pytest

from starward.sources.csv_files import read_folder, read_source, source_paths
from starward.sources.schemas import RAW_COLUMNS

HEADER = ",".join(f"column {i}" for i in range(14))


def spending_file(tmp_path, *lines):
    path = tmp_path / "spending.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def line(name="Name", score="1.0"):
    return f'010001,{name},,,TX,,,,MSPB-1,Spending,{score},"",01/01/2024,12/31/2024'


@pytest.mark.parametrize(
    "source, width",
    [
        ("hospital_info", 38),
        ("complications", 18),
        ("infections", 15),
        ("unplanned_visits", 20),
        ("patient_survey", 22),
        ("spending", 14),
    ],
)
def test_layout_widths(source, width):
    assert len(RAW_COLUMNS[source]) == len(set(RAW_COLUMNS[source])) == width


def test_columns_are_by_position_and_empty_is_null(spark, tmp_path):
    (row,) = read_source(spark, "spending", spending_file(tmp_path, line())).collect()
    assert (row.facility_id, row.score, row.end_date) == ("010001", "1.0", "12/31/2024")
    assert row.address is None and row.footnote is None


def test_doubled_quotes_and_commas(spark, tmp_path):
    path = spending_file(tmp_path, line(name='"He said ""hi"", ok"'))
    assert read_source(spark, "spending", path).first().facility_name == 'He said "hi", ok'


def test_line_break_in_quotes(spark, tmp_path):
    path = spending_file(tmp_path, line(name='"two\nlines"'))
    row = read_source(spark, "spending", path, multi_line=True).first()
    assert row.facility_name == "two\nlines"
    with pytest.raises(Exception, match="MALFORMED"):
        read_source(spark, "spending", path).collect()


@pytest.mark.parametrize("bad", [line() + ",extra", "010001,too,short"])
def test_wrong_number_of_fields_stops(spark, tmp_path, bad):
    with pytest.raises(Exception, match="MALFORMED"):
        read_source(spark, "spending", spending_file(tmp_path, line(), bad)).collect()


def test_folder_with_the_usual_names(spark, sample_star, tmp_path):
    for source, path in source_paths(str(tmp_path)).items():
        sample_star.raw[source].write.options(header=True, escape='"').csv(path)
    found = read_folder(spark, str(tmp_path))
    assert found.keys() == RAW_COLUMNS.keys()
    for source, df in found.items():
        assert df.count() == sample_star.raw[source].count()
