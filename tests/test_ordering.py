from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starward.operators import joins
from starward.operators.ordering import (
    global_ntile,
    global_ranks,
    global_row_number,
    running_counts,
)
from starward.operators.statistics import (
    approximate_percentiles,
    exact_percentiles,
    measure_columns,
    with_share,
)

SIZES = [0, 1, 3, 10, 2003]


def table(spark, size, distinct=40, hot=0.33):
    """Random values; one of them holds a third of the rows."""
    rng = random.Random(size)
    rows = [(i, 7 if rng.random() < hot else rng.randrange(distinct)) for i in range(size)]
    return spark.createDataFrame(rows, "id long, v int").withColumn(
        "v", F.col("v").cast("decimal(20,10)")
    )


def same(a, b):
    left, right = a.collect(), b.select(a.columns).collect()
    return sorted(map(tuple, left), key=repr) == sorted(map(tuple, right), key=repr)


@pytest.fixture(params=["true", "false"])
def coalescing(request, conf):
    """With and without merging of small partitions: 1 and 8 sorted partitions."""
    conf("spark.sql.adaptive.coalescePartitions.enabled", request.param)


@pytest.mark.parametrize("size", SIZES)
def test_row_number_equals_window(spark, coalescing, size):
    df = table(spark, size)
    window = Window.orderBy("v", "id")
    numbered = global_row_number(df, ["v", "id"], "rn", "total")
    expected = df.withColumn("rn", F.row_number().over(window)).withColumn("total", F.lit(size))
    assert same(numbered, expected)


@pytest.mark.parametrize(
    "size, hot, tiles",
    [(0, 0, 4), (1, 0, 4), (3, 0, 4), (3, 1, 7), (10, 1, 4), (503, 0, 4), (503, 0.33, 4)]
    + [(503, 0.33, 1), (503, 0.33, 7), (503, 1, 4)],
)
def test_ntile_equals_window(spark, conf, size, hot, tiles):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = table(spark, size, hot=hot)
    expected = df.withColumn("t", F.ntile(tiles).over(Window.orderBy("v", "id")))
    assert same(global_ntile(df, tiles, "v", "id", "t"), expected)


def test_ntile_of_distinct_values(spark, coalescing, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    df = table(spark, 1001, distinct=10**6, hot=0)
    expected = df.withColumn("t", F.ntile(4).over(Window.orderBy("v", "id")))
    assert same(global_ntile(df, 4, "v", "id", "t"), expected)


@pytest.mark.parametrize("broadcast_rows", [joins.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("size", [0, 1, 503])
def test_ranks_equal_window(spark, monkeypatch, size, broadcast_rows):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", broadcast_rows)
    monkeypatch.setattr(joins, "HOT_SHARE", 5)
    df = table(spark, size)
    window = Window.orderBy("v")
    expected = df.withColumns(
        {"rank": F.rank().over(window), "percent_rank": F.percent_rank().over(window)}
    )
    assert same(global_ranks(df, "v"), expected)


def test_percent_rank_of_ties_is_zero(spark):
    ranked = global_ranks(table(spark, 10, hot=1), "v")
    assert {r.percent_rank for r in ranked.collect()} == {0.0}


def test_running_counts_per_group(spark, coalescing):
    df = table(spark, 500).withColumn("g", F.col("id") % 3)
    group = Window.partitionBy("g")
    expected = (
        df.withColumn("below", F.rank().over(group.orderBy("v")) - 1)
        .withColumn("total", F.count("*").over(group))
        .withColumn("n", F.count("*").over(Window.partitionBy("g", "v")))
        .distinct()
        .drop("id")
        .distinct()
    )
    assert same(running_counts(df, "v", ["g"]), expected)


@pytest.mark.parametrize("size", [1, 10, 2003])
def test_percentiles_equal_the_builtin(spark, coalescing, size):
    points = {"p10": 0.1, "median": 0.5, "p90": 0.9, "least": 0.0, "most": 1.0}
    df = table(spark, size).withColumn("g", (F.col("id") % 2).cast("string"))
    array = F.percentile("v", F.array(*[F.lit(p) for p in points.values()]))
    expected = {r.g: r.q for r in df.groupBy("g").agg(array.alias("q")).collect()}
    found = exact_percentiles(df, "v", points, ["g"]).collect()
    assert {r.g for r in found} == expected.keys()
    for row in found:
        assert [row[name] for name in points] == pytest.approx(expected[row.g])


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_lookup_join_with_hot_and_null_keys(spark, monkeypatch, how, broadcast_rows):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", broadcast_rows)
    monkeypatch.setattr(joins, "HOT_SHARE", 4)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 20}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string")
    names = [("hot", 1), *[(f"k{i}", i) for i in range(0, 20, 2)]]
    lookup = spark.createDataFrame(names, "k string, value int")
    found = joins.join_lookup(df, lookup, ["k"], how)
    assert same(found, df.join(lookup, ["k"], how))


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "g string, n long")
    assert {r.g: r.pct for r in with_share(df, "n", "pct").collect()} == {"a": 33.3, "b": 66.7}


def test_measure_columns_is_one_pass(spark):
    rows = [("1", "A", 5), ("1", "B", 6), ("2", "A", 7), ("2", "C", 8), ("3", "C", 9)]
    fact = spark.createDataFrame(rows, "facility_id string, measure_id string, score int")
    found = measure_columns(fact, {"a": ("A", "score"), "b": ("B", "score")}).collect()
    assert sorted(map(tuple, found)) == [("1", 5, 6), ("2", 7, None)]


@pytest.mark.parametrize("accuracy", [20, 100, 1000])
def test_sketches_stay_within_their_rank_error(spark, accuracy):
    """A third of all rows share one value; every estimate is checked against exact ranks."""
    rng = random.Random(accuracy)
    rows = [
        (g, None if rng.random() < 0.05 else 7.0 if rng.random() < 0.33 else rng.gauss(0, 50))
        for g, size in enumerate([1, 2, 500, 20_000])
        for _ in range(size)
    ]
    points = {f"p{k}": k / 100 for k in (0, 1, 10, 50, 90, 99, 100)}
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    found = approximate_percentiles(df, "v", points, ["g"], accuracy).collect()
    assert len(found) == 4
    for row in found:
        own = sorted(v for g, v in rows if g == row.g and v is not None)
        for name, share in points.items():
            if not own:
                assert row[name] is None
                continue
            low, high = own.index(row[name]) + 1, len(own) - own[::-1].index(row[name])
            wanted, allowed = max(share * len(own), 1), len(own) / accuracy + 1
            assert low - allowed <= wanted <= high + allowed


def test_sketches_of_small_groups_are_exact(spark):
    df = spark.createDataFrame([(k,) for k in range(1, 1002)], "v int").select(F.lit("x").alias("g"), "v")
    points = {"low": 0.1, "middle": 0.5, "high": 0.9}
    assert approximate_percentiles(df, "v", points, ["g"]).first()[1:] == (101.0, 501.0, 901.0)
    assert approximate_percentiles(df.where("v < 0"), "v", points, ["g"]).collect() == []
