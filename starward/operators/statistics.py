"""Statistics that a plain aggregate would gather in one task or one buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starward.functions.measures import percent
from starward.operators.ordering import running_counts


def exact_percentiles(
    df: DataFrame, value: str, points: dict[str, float], by: list[str]
) -> DataFrame:
    """Percentiles with linear interpolation, as doubles named after ``points``.

    The built-in ``percentile`` holds every distinct value of a group in one buffer. Running
    counts tell which values sit at the two neighbouring positions of each percentile, so the
    aggregate keeps two values per percentile.
    """
    counts = running_counts(df, value, by)
    below, upto = F.col("below"), F.col("below") + F.col("n")
    aggregates: list[Column] = []
    results: list[Column] = []
    for name, point in points.items():
        position = (F.col("total") - 1) * F.lit(float(point))
        low, high = F.floor(position), F.ceil(position)
        v = F.col(value).cast("double")
        aggregates += [
            F.max(F.when((below <= low) & (low < upto), v)).alias(f"_{name}_low"),
            F.max(F.when((below <= high) & (high < upto), v)).alias(f"_{name}_high"),
            F.max(position - low).alias(f"_{name}_part"),
        ]
        lower, upper = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        results.append((lower + (upper - lower) * F.col(f"_{name}_part")).alias(name))
    return counts.groupBy(*by).agg(*aggregates).select(*by, *results)


def approximate_percentiles(
    df: DataFrame, value: str, points: dict[str, float], by: list[str], accuracy: int = 10_000
) -> DataFrame:
    """Percentiles from a mergeable quantile sketch, as doubles named after ``points``.

    Each is a value of the group whose rank is at most (rows of the group) / ``accuracy`` away
    from that of the exact one, without interpolation; groups of less than ``accuracy`` / 2 rows
    are exact. NULLs do not count; a group without values has NULLs. Unlike ``exact_percentiles``
    nothing is sorted or written: one scan, and one sketch per task and group is shuffled, the
    size of which grows with ``accuracy`` and not with the rows.
    """
    sketch = F.percentile_approx(F.col(value).cast("double"), list(points.values()), accuracy)
    return (
        df.groupBy(*by)
        .agg(sketch.alias("_found"))
        .select(*by, *[F.get("_found", n).alias(name) for n, name in enumerate(points)])
    )


def with_share(counts: DataFrame, count: str, name: str, digits: int = 1) -> DataFrame:
    """Add each group's percent of the total, which is one scalar and not a global window."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(name, percent(F.col(count), total, digits))


def measure_columns(fact: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per facility with one column per (measure, fact column), in one pass.

    Equal to one join per measure because (facility_id, measure_id) is a key of every fact.
    """
    measures = sorted({measure for measure, _ in columns.values()})
    return (
        fact.where(F.col("measure_id").isin(measures))
        .groupBy("facility_id")
        .agg(
            *[
                F.max(F.when(F.col("measure_id") == measure, F.col(column))).alias(name)
                for name, (measure, column) in columns.items()
            ]
        )
    )
