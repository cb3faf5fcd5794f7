"""Order of rows, and what sets similar questions apart, on hand-made sources."""

from __future__ import annotations

import small

from starward.plans import dashboard, explore, standalone


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def states(**ratings_by_state):
    """Hospitals numbered from 1, given as state -> ratings."""
    result, number = [], 0
    for state, ratings in ratings_by_state.items():
        for rating in ratings:
            number += 1
            result.append(small.hospital(str(number), state=state, rating=rating))
    return result


def test_unrated_state_ranks_first_but_comes_last_where_asked(spark, tmp_path):
    hospitals = states(AA=["5"] * 2, BB=["Not Available"] * 2, CC=["1"] * 2)
    star = small.small_star(
        spark,
        tmp_path,
        hospital_info=hospitals,
        spending=[small.spending(str(i), f"{i / 10}") for i in range(1, 7)],
    )
    ranks = dashboard.state_ranks(star, minimum=1)
    assert rows(ranks, "state", "star_rank", "spending_rank") == [
        ("BB", 1, 2),
        ("AA", 2, 3),
        ("CC", 3, 1),
    ]
    by_state = standalone.stars_by_state(star, minimum=1)
    assert rows(by_state, "state", "avg_rating") == [("AA", 5.0), ("CC", 1.0), ("BB", None)]
    ownership = dashboard.stars_and_spending_by_ownership(star, minimum=1)
    assert rows(ownership, "hospitals", "avg_star_rating") == [(6, 3.0)]
    distribution = explore.star_distribution(star)
    assert rows(distribution, "overall_rating") == [(1,), (5,), (None,)]
    labelled = explore.star_distribution_labelled(star)
    assert rows(labelled, "star_rating") == [("1 stars",), ("5 stars",), ("Not rated",)]


def test_left_and_inner_join_by_state_differ(spark, tmp_path):
    star = small.small_star(
        spark,
        tmp_path,
        hospital_info=states(AA=["5", "1"]),
        spending=[small.spending("1", "1.0")],
    )
    left = explore.spending_and_stars_by_state(star, minimum=1)
    inner = standalone.state_spending_and_stars(star, minimum=1)
    assert rows(left, "hospitals_with_spending", "avg_star_rating") == [(1, 3.0)]
    assert rows(inner, "hospitals", "avg_star_rating") == [(1, 5.0)]


def test_a_second_spending_measure_counts_only_where_no_measure_is_named(spark, tmp_path):
    star = small.small_star(
        spark,
        tmp_path,
        hospital_info=states(AA=["4"]),
        spending=[small.spending("1", "0.9"), small.spending("1", "1.5", "OTHER")],
        complications=[small.result("1", "MORT_30_HF", "10")],
    )
    named = dashboard.mortality_by_state(star)
    every = dashboard.mortality_by_state(star, spending_measure=None)
    columns = ("avg_hf_mortality", "avg_spending_ratio", "n_hospitals")
    assert rows(named, *columns) == [(10.0, 0.9, 1)]
    assert rows(every, *columns) == [(10.0, 1.2, 1)]
    assert dashboard.spending_vs_mortality(star).count() == 1
    assert dashboard.spending_vs_mortality(star, spending_measure=None).count() == 2
    assert dashboard.top_rated_by_spending_level(star).count() == 1
    assert dashboard.top_rated_by_spending_level(star, spending_measure=None).count() == 2


def test_best_value_keeps_ties_and_takes_the_mean_over_all_hospitals(spark, tmp_path):
    star = small.small_star(
        spark,
        tmp_path,
        hospital_info=states(AA=["4", "5", "4", "4", "4", "1"]),
        spending=[
            small.spending(str(i), score)
            for i, score in enumerate(["0.9", "0.9", "1.0", "1.0", "1.1", "2.1"], 1)
        ],
    )
    best = standalone.best_value_hospitals(star)
    # The 5-star hospital wins the tie at 0.9; two hospitals share rank 3; mean ratio 7.0 / 6.
    assert rows(best, "value_rank", "facility_name", "mspb_vs_state_avg") == [
        (1, "Hospital 2", -0.267),
        (2, "Hospital 1", -0.267),
        (3, "Hospital 3", -0.167),
        (3, "Hospital 4", -0.167),
    ]


def test_bands_are_cut_on_exact_decimals(spark, tmp_path):
    scores = ["0.95", "1.15", "0.9499"]
    star = small.small_star(
        spark,
        tmp_path,
        hospital_info=states(AA=["4"] * 3),
        spending=[small.spending(str(i), s) for i, s in enumerate(scores, 1)],
    )
    assert rows(dashboard.spending_histogram(star), "spending_bucket", "hospitals") == [
        (0.9, 1),
        (0.95, 1),
        (1.15, 1),
    ]


def test_fewer_hospitals_than_quartiles(spark, tmp_path):
    star = small.small_star(
        spark,
        tmp_path,
        hospital_info=states(AA=["4"] * 3),
        spending=[small.spending(str(i), f"0.{i}") for i in (1, 2, 3)],
    )
    found = dashboard.outcomes_by_spending_quartile(star)
    assert rows(found, "spending_quartile", "hospitals") == [
        ("Q1 (lowest spend)", 1),
        ("Q2", 1),
        ("Q3", 1),
    ]


def test_topics_with_the_same_name_count_a_hospital_once(spark, tmp_path):
    same = {"hcahps_question": "Nurses - star rating"}
    star = small.small_star(
        spark,
        tmp_path,
        hospital_info=states(AA=["4"] * 4),
        spending=[small.spending(str(i), f"0.{i}") for i in range(1, 5)],
        patient_survey=[
            small.survey(str(i), measure, stars, **same)
            for i, stars in enumerate(["1", "2", "3", "5"], 1)
            for measure in ("N_1", "N_2")
        ],
    )
    gap = dashboard.survey_topic_gaps(star, minimum=1)
    columns = ("survey_topic", "lowest_spend_stars", "highest_spend_stars", "star_gap", "hospitals")
    assert rows(gap, *columns) == [("Nurses", 1.0, 5.0, 4.0, 2)]


def test_correlation_of_a_constant_series_is_null(spark, tmp_path):
    star = small.small_star(
        spark,
        tmp_path,
        hospital_info=states(AA=["4", "4"]),
        spending=[small.spending("1", "0.9"), small.spending("2", "1.1")],
    )
    assert rows(explore.spending_star_correlation(star), "correlation") == [(None,)]


def test_spread_of_a_single_hospital_is_null(spark, tmp_path):
    star = small.small_star(
        spark, tmp_path, hospital_info=states(AA=["4"]), spending=[small.spending("1", "0.9")]
    )
    found = rows(dashboard.metric_spread(star), "metric", "std_dev", "cv_pct", "median")
    assert ("Medicare spending ratio (1.0 = national median)", None, None, 0.9) in found


def test_spot_check_of_a_hand_made_hospital(spark, tmp_path):
    star = small.small_star(
        spark,
        tmp_path,
        hospital_info=[small.hospital("10001", city_town="DOTHAN")],
        spending=[small.spending("10001", "0.99")],
        patient_survey=[small.survey("10001", stars="4")],
    )
    assert [tuple(r) for r in explore.spot_check(star).collect()] == [
        ("010001", "Hospital 10001", "DOTHAN", "TX", 3, 0.99, 4)
    ]
    assert explore.spot_check(star, "999999").count() == 0


def test_points_are_sorted_by_ratio(sample_star):
    points = dashboard.spending_vs_readmission(sample_star)
    ratios = [r.mspb_ratio for r in points.collect()]
    assert ratios == sorted(ratios)
    recommended = dashboard.recommendation_points(sample_star).collect()
    keys = [(-r.mspb_ratio, r.patient_survey_stars or 9) for r in recommended]
    assert keys == sorted(keys)
