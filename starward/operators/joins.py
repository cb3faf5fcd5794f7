"""Joins with lookup tables: one row per key on one side, any number on the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starward.sources.shared import write_shared

# Lookup tables of up to this many bytes are broadcast.
BROADCAST_BYTES = 16 << 20
# In a shuffle join, a key that holds more than 1/HOT_SHARE of the rows is joined on its own.
HOT_SHARE = 1000


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the values of a table: text as it is, eight for anything else."""
    widths = [
        F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() == "string" else F.lit(8)
        for f in df.schema
    ]
    return df.agg(F.sum(reduce(lambda a, b: a + b, widths).cast("long"))).first()[0] or 0


def join_lookup(
    df: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    weights: DataFrame | None = None,
) -> DataFrame:
    """Join (``inner`` or ``left``) with a stored table that has one row per key.

    The lookup is measured, which scans it once, and broadcast if it is small. A larger one is joined by shuffle, in three parts: rows of hot keys, of which there are
    fewer than HOT_SHARE, stay where they are and meet a broadcast of just those keys; rows
    with a NULL key match nothing and do not move; the rest is even enough to be shuffled.
    ``weights`` (key columns and ``n``) saves counting the rows per key here.
    """
    if measured_bytes(lookup) <= BROADCAST_BYTES:
        return df.join(F.broadcast(lookup), on, how)

    if weights is None:
        weights = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    weights = write_shared(weights.select(*on, "n"), "weights")
    total = weights.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Bounded: fewer than HOT_SHARE keys can hold more than 1/HOT_SHARE of the rows each.
    hot = F.broadcast(weights.where(F.col("n") * HOT_SHARE > total).select(*on))

    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    keyed = df.where(~no_key)
    parts = [
        keyed.join(hot, on, "left_semi").join(
            F.broadcast(lookup.join(hot, on, "left_semi")), on, how
        ),
        keyed.join(hot, on, "left_anti").join(lookup, on, how),
    ]
    if how == "left":
        added = [f for f in lookup.schema if f.name not in on]
        parts.append(
            df.where(no_key).select(
                "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added]
            )
        )
    return reduce(DataFrame.unionByName, parts)
