from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from starward.plans import explore, job
from starward.plans.catalogue import DASHBOARD, HEADLINE
from starward.plans.publish import prune_results, publish_questions, published_result
from starward.sources.shared import shared_folder
from starward.sources.csv_files import source_paths


def status(df):
    return {r.name: (r.status, r.row_count) for r in df.collect()}


def test_the_dashboard_has_24_questions_and_3_headline_numbers():
    assert (len(DASHBOARD), len(HEADLINE)) == (24, 3)


def test_created_kept_updated_failed(spark, sample_star, tmp_path):
    def broken(star):
        return star["dim_hospital"].select("no_such_column")

    questions = {"stars": explore.star_distribution, "broken": broken}
    folder = str(tmp_path)
    first = publish_questions(sample_star, questions, folder)
    assert status(first) == {"stars": ("created", 6), "broken": ("failed", None)}
    assert "no_such_column" in first.where("name = 'broken'").first().error
    again = publish_questions(sample_star, questions, folder)
    assert status(again)["stars"] == ("kept", 6)
    forced = publish_questions(sample_star, questions, folder, overwrite=True)
    assert status(forced)["stars"] == ("updated", 6)
    stored = published_result(spark, folder, "stars")
    assert stored.exceptAll(explore.star_distribution(sample_star)).count() == 0


def test_what_failed_while_running_is_run_again(spark, sample_star, tmp_path):
    def failing(star):
        return star["dim_hospital"].select(F.raise_error(F.lit("stop")).cast("int").alias("x"))

    folder = str(tmp_path)
    assert status(publish_questions(sample_star, {"q": failing}, folder))["q"] == ("failed", None)
    with pytest.raises(LookupError):
        published_result(spark, folder, "q")
    good = publish_questions(sample_star, {"q": explore.star_distribution}, folder)
    assert status(good)["q"] == ("created", 6)
    worse = publish_questions(sample_star, {"q": failing}, folder, overwrite=True)
    assert status(worse)["q"] == ("failed", None)
    assert published_result(spark, folder, "q").count() == 6


def test_readers_keep_their_version(spark, sample_star, tmp_path):
    folder, question = str(tmp_path), {"q": explore.star_distribution}
    publish_questions(sample_star, question, folder)
    reader = published_result(spark, folder, "q")
    publish_questions(sample_star, {"q": lambda star: star["dim_hospital"].limit(2)}, folder, overwrite=True)
    assert reader.count() == 6 and published_result(spark, folder, "q").count() == 2


def versions(folder, name="q"):
    return sorted(p.name for p in (Path(folder) / name).iterdir() if p.is_dir() and p.name != "published")


def test_replaced_results_go(spark, sample_star, tmp_path):
    folder, question = str(tmp_path), {"q": explore.star_distribution, "r": explore.star_distribution}
    for _ in range(4):
        publish_questions(sample_star, question, folder, overwrite=True)
    assert len(versions(folder)) == len(versions(folder, "r")) == 4
    removed = prune_results(spark, folder, keep=2)
    assert len(versions(folder)) == len(versions(folder, "r")) == 2
    assert sorted(map(len, removed.values())) == [2, 2]
    assert published_result(spark, folder, "q").count() == 6
    assert prune_results(spark, folder, keep=2) == {"q": [], "r": []}
    prune_results(spark, folder, keep=0)
    assert len(versions(folder)) == 1 and published_result(spark, folder, "q").count() == 6


def test_failed_and_killed_runs_leave_nothing_for_long(spark, sample_star, tmp_path):
    def failing(star):
        return star["dim_hospital"].select(F.raise_error(F.lit("stop")).cast("int").alias("x"))

    folder = str(tmp_path)
    publish_questions(sample_star, {"q": explore.star_distribution}, folder)
    publish_questions(sample_star, {"q": failing, "new": failing}, folder, overwrite=True)
    assert len(versions(folder)) == 1
    (tmp_path / "q" / "killed").mkdir()
    assert prune_results(spark, folder)["q"] == []
    assert prune_results(spark, folder, unfinished_hours=-1)["q"] == ["killed"]
    assert len(versions(folder)) == 1 and published_result(spark, folder, "q").count() == 6
    assert prune_results(spark, str(tmp_path / "nowhere")) == {}


def test_publishing_leaves_no_intermediate_tables(spark, sample_star, tmp_path):
    place = Path(shared_folder(spark).removeprefix("file:")) / "starward"
    before = set(place.iterdir()) if place.exists() else set()
    publish_questions(sample_star, {"spread": DASHBOARD["metric_spread"]}, str(tmp_path))
    assert (set(place.iterdir()) if place.exists() else set()) == before


def test_the_job_loads_checks_and_publishes(spark, sample_star, tmp_path, capsys):
    for source, path in source_paths(str(tmp_path / "csv")).items():
        sample_star.raw[source].write.options(header=True, escape='"').csv(path)
    job.main([str(tmp_path / x) for x in ("csv", "star", "results")])
    assert "failed" not in capsys.readouterr().out
    assert published_result(spark, str(tmp_path / "results"), "star_distribution").count() == 6
