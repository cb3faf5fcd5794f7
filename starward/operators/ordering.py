"""Row numbers, tiles and ranks over a whole table without a single-task window.

``row_number() over (order by ...)`` without a partition moves the table to one task. Here the
rows are range-partitioned on the sort keys, sorted inside each partition and written once
with ``monotonically_increasing_id``, which holds the partition number and the row's place in
the partition. One row per partition then gives the offset of each partition.

The sorted rows must be written: bounds of a range partitioning come from a sample, so two
evaluations may cut at different places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starward.operators.joins import join_lookup
from starward.sources.shared import write_shared

# monotonically_increasing_id: partition number above bit 33, row in partition below.
_PLACE_BITS = 33


def div(a: Column, b: Column) -> Column:
    """Integer division."""
    return F.call_function("div", a, b)


def _sorted_once(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    return write_shared(placed, label).select(
        *df.columns,
        F.shiftright("_place", _PLACE_BITS).alias("_part"),
        F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("_row"),
    )


def _offsets(sizes: DataFrame, by: list[str]) -> DataFrame:
    """(by, _part, _n) to (by, _part, _offset, _total): rows in earlier partitions, and in all.

    The windows see one row per shuffle partition and group.
    """
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *by,
        "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(group).alias("_total"),
    )


def global_row_number(
    df: DataFrame, keys: list[str], name: str = "row_number", total: str | None = None
) -> DataFrame:
    """Number all rows 1..N in the order of ``keys``.

    ``keys`` should identify a row: then the numbering is deterministic, and a value shared by
    very many rows is still split over partitions. ``total`` names an extra column holding N.
    """
    rows = _sorted_once(df, keys, "ordered")
    sizes = rows.groupBy("_part").agg((F.max("_row") + 1).alias("_n"))
    # Bounded: one row per shuffle partition.
    numbered = rows.join(F.broadcast(_offsets(sizes, [])), "_part")
    out = [*df.columns, (F.col("_offset") + F.col("_row") + 1).alias(name)]
    if total:
        out.append(F.col("_total").alias(total))
    return numbered.select(*out)


def running_counts(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """One row per distinct value (per group): rows with it, rows below it, rows in the group.

    Columns: ``by``, ``value``, ``n``, ``below``, ``total``. Rows are counted per value before
    anything moves, so the sort handles distinct values, however unevenly rows spread on them.
    The columns of ``by`` must not be NULL.
    """
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    rows = _sorted_once(counts, [*by, value], "counts")
    keys = [*by, "_part"]
    offsets = _offsets(rows.groupBy(*keys).agg(F.sum("n").alias("_n")), by)
    if not by:
        # Bounded: one row per shuffle partition.
        offsets = F.broadcast(offsets)
    # Partitions of a range sort are even, and so are these windows.
    earlier = Window.partitionBy(*keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_local", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(offsets, keys)
        .select(
            *by,
            value,
            "n",
            (F.col("_offset") + F.col("_local")).alias("below"),
            F.col("_total").alias("total"),
        )
    )


def _tile(position: Column, total: Column, tiles: int) -> Column:
    """Tile (from 1) of a position (from 0): sizes differ by one at most, larger tiles first."""
    size, larger = div(total, F.lit(tiles)), total % tiles
    in_larger = larger * (size + 1)
    # With fewer rows than tiles size is 0 and every position falls in the first branch.
    tile = F.when(position < in_larger, div(position, size + 1)).otherwise(
        larger + div(position - in_larger, F.greatest(size, F.lit(1)))
    )
    return (tile + 1).cast("int")


def global_ntile(
    df: DataFrame, tiles: int, value: str, tiebreak: str, name: str = "tile"
) -> DataFrame:
    """``ntile(tiles) over (order by value, tiebreak)``; ``value`` must not be NULL.

    Counts per value settle all rows whose value lies in a single tile. Only values cut by the
    border of two tiles, of which there are fewer than ``tiles``, have their rows put in order.
    """
    below, n, total = F.col("below"), F.col("n"), F.col("total")
    placed = write_shared(
        running_counts(df, value).select(
            value,
            "n",
            "below",
            "total",
            _tile(below, total, tiles).alias(name),
            _tile(below + n - 1, total, tiles).alias("_last"),
        ),
        "tiles",
    )
    whole = placed.where(F.col(name) == F.col("_last"))
    cut = placed.where(F.col(name) < F.col("_last"))
    settled = join_lookup(df, whole.select(value, name), [value], weights=placed)
    settled = settled.select(*df.columns, name)
    if cut.isEmpty():
        return settled
    # Bounded: fewer rows than tiles, in the window and in the broadcast.
    earlier = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    skipped = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    cut = cut.select(value, "total", (below - skipped).alias("_shift"))
    ordered = global_row_number(
        df.join(F.broadcast(cut), value), [value, tiebreak], "_rn"
    )
    position = F.col("_rn") - 1 + F.col("_shift")
    return settled.unionByName(
        ordered.withColumn(name, _tile(position, total, tiles)).select(*df.columns, name)
    )


def global_ranks(
    df: DataFrame, value: str, rank: str = "rank", percent_rank: str = "percent_rank"
) -> DataFrame:
    """``rank()`` and ``percent_rank()`` over (order by value), as two added columns.

    The percent rank is (rank - 1) / (N - 1), and 0 for a single row.
    """
    below, total = F.col("below"), F.col("total")
    counts = running_counts(df, value).select(
        value,
        "n",
        (below + 1).alias(rank),
        F.when(total > 1, below / (total - 1)).otherwise(F.lit(0.0)).alias(percent_rank),
    )
    ranks = write_shared(counts, "ranks")
    joined = join_lookup(df, ranks.drop("n"), [value], weights=ranks)
    return joined.select(*df.columns, rank, percent_rank)
