"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors fall into classes first. The classes are dealt to blocks of bounded size and every
two blocks meet in one task. There each unit vector u is s * q + e with q in whole numbers of
-127 to 127, and the length of e is known, so for two vectors

    |u . v - s s' (q . q')|  <=  |s q| |e'| + |e| |v|.

What is sent to the other blocks is q, one byte a component, with s and the two lengths. The product
of the q of two tiles is exact, and a task returns the vectors that have a partner whose product plus
the bound reaches the threshold. Only their vectors in double precision are sent to a second task
of the same two blocks, which computes such pairs again. It returns, for its vectors, the number of
links and a spanning forest of them. Neither returns pairs.

All pairs of blocks are multiplied, so work grows with the square of the number of distinct
vectors; that is the method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starward.llm.components import connected_components, local_roots
from starward.llm.packing import pack_strings, unpack_strings
from starward.sources.shared import write_shared

#: Vectors of a block, rows of a tile, and pairs computed again at once.
BLOCK, TILE, EXACT = 4096, 1024, 1 << 16
#: Terms of a product of int8 values that single precision adds up exactly (127 * 127 * 1024 < 2**24).
TERMS = 1024
#: Allowance for rounding in double precision.
SLACK = 1e-9


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q as int8, s, length of s * q and length of the error of every row."""
    scale = np.abs(units).max(axis=1) / 127
    q = np.rint(units / scale[:, None])
    coarse = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(coarse, axis=1), np.linalg.norm(units - coarse, axis=1)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: single precision adds up ``TERMS`` terms without rounding."""
    parts = [
        left[:, k : k + TERMS].astype(np.float32) @ right[:, k : k + TERMS].astype(np.float32).T
        for k in range(0, left.shape[1], TERMS)
    ]
    return parts[0] if len(parts) == 1 else sum(part.astype(np.float64) for part in parts)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square overflows or vanishes; exact."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled rows, so nothing overflows."""
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def possible(left: tuple, right: tuple, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of two quantised blocks whose product plus the bound reaches the threshold.

    A tile of ``left`` at a time; of one block (``same``) only i < j.
    """
    (q, s, length, error), (q2, s2, _, error2) = left, right
    for k in range(0, len(q), TILE):
        tile = slice(k, k + TILE)
        bound = length[tile, None] * error2 + error[tile, None] + SLACK
        near = product(q[tile], q2) * (s[tile, None] * s2) + bound >= threshold
        if same:
            near &= np.arange(len(q2)) > np.arange(k, k + len(near))[:, None]
        i, j = np.nonzero(near)
        yield i + k, j


def links(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked vectors of two blocks; of one block (``same``) only i < j."""
    left, right = map(scaled, (left, right))
    found = []
    for i, j in possible(quantised(units(left)), quantised(units(right)), threshold, same):
        for m in range(0, len(i), EXACT):
            a, b = i[m : m + EXACT], j[m : m + EXACT]
            exact = np.einsum("nd,nd->n", left[a], right[b]) / (
                np.linalg.norm(left[a], axis=1) * np.linalg.norm(right[b], axis=1)
            )
            found.append(np.stack([a[exact >= threshold], b[exact >= threshold]]))
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, int), np.zeros(0, int))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _pack(rows: pa.Table) -> pa.Table:
    """One row per block: ids and quantised vectors as bytes."""
    q, *lengths = quantised(units(scaled(_matrix(rows["vector"]))))
    data = [np.ascontiguousarray(x).tobytes() for x in (rows["id"].to_numpy(), q, np.stack(lengths))]
    return pa.table(
        {"dim": rows["dim"][:1], "block": rows["block"][:1], "blocks": rows["blocks"][:1], "data": [pack_strings(data)]}
    )


def _suspects(threshold: float) -> Callable:
    """The vectors of two blocks that may have a partner in the other."""

    def suspects(rows: pa.Table) -> pa.Table:
        blocks = []
        for packed in rows.sort_by("block")["data"]:
            ids, q, lengths = unpack_strings(packed.as_py())
            ids = np.frombuffer(ids, np.int64)
            blocks.append((ids, (np.frombuffer(q, np.int8).reshape(len(ids), -1), *np.frombuffer(lengths).reshape(3, -1))))
        (ids, left), (ids2, right) = blocks[0], blocks[-1]
        found = [np.zeros(len(ids), bool), np.zeros(len(ids2), bool)]
        for i, j in possible(left, right, threshold, len(blocks) == 1):
            found[0][i] = True
            found[1][j] = True
        if len(blocks) == 1:
            own, side = ids[found[0] | found[1]], np.zeros(int((found[0] | found[1]).sum()), bool)
        else:
            own = np.concatenate([ids[found[0]], ids2[found[1]]])
            side = np.repeat([False, True], [int(found[0].sum()), int(found[1].sum())])
        low, high = (min(x.as_py() for x in rows["low"]), max(x.as_py() for x in rows["high"]))
        n = len(own)
        return pa.table({"dim": pa.array(np.full(n, rows["dim"][0].as_py(), np.int32)), "low": pa.array(np.full(n, low)), "high": pa.array(np.full(n, high)), "right": pa.array(side), "id": pa.array(own)})

    return suspects


def _exact(threshold: float) -> Callable:
    """Links of the suspects of two blocks: per class its partners there, and the class it is joined to."""

    def exact(rows: pa.Table) -> pa.Table:
        same = rows["low"][0].as_py() == rows["high"][0].as_py()
        sides = [rows] if same else [rows.filter(pc.invert(rows["right"])), rows.filter(rows["right"])]
        left, right = sides[0], sides[-1]
        a, b = links(_matrix(left["vector"]), _matrix(right["vector"]), threshold, same)
        ids, counts = (np.concatenate([side[name].to_numpy() for side in sides]) for name in ("id", "n"))
        b = b if same else b + left.num_rows
        partners = np.bincount(a, counts[b], len(ids)) + np.bincount(b, counts[a], len(ids))
        root = ids[local_roots(a, b, len(ids))]
        linked = partners > 0
        return pa.table(
            {
                "id": ids[linked],
                "partners": partners[linked].astype(np.int64),
                "root": root[linked],
            }
        )

    return exact


def embedding_duplicates(
    embeddings: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """One row per row of ``embeddings``: key, n_links, component_id, kept.

    Vectors are linked if their cosine in double precision is at least ``threshold``. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors
    of different lengths. ``n_links`` counts other rows linked directly, equal ones included.
    ``component_id`` is the smallest key reachable, ``kept`` says that it is the row's own. Keys
    are integers; rows that repeat a key are rows of one node. A null key links with nothing and is
    kept under a null component. Very long vectors are held whole by a task. Other columns are not read, whatever their names. An empty table
    gives an empty result.
    """
    values = F.col(vector).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists(values, lambda x: x != 0), F.lit(False)) & F.col(key).isNotNull()
    rows = embeddings.select(F.col(key).cast("long").alias("key"), F.when(usable, values).alias("vector"))
    rows = write_shared(rows, "vectors")
    classes = write_shared(
        rows.where("vector IS NOT NULL")
        .groupBy("vector")
        .agg(F.min("key").alias("least"), F.count("key").alias("n"))
        .select("*", F.monotonically_increasing_id().alias("id"), F.size("vector").alias("dim")),
        "vector-classes",
    )
    blocks = classes.groupBy("dim").agg(F.ceil(F.count("id") / BLOCK).alias("blocks"))
    packed = (
        classes.join(blocks, "dim")
        .withColumn("block", F.pmod(F.xxhash64("vector"), F.col("blocks")))
        .select("dim", "block", "blocks", "id", "vector")
        .groupBy("dim", "block")
        .applyInArrow(_pack, "dim int, block long, blocks long, data binary")
    )
    packed = write_shared(packed, "vector-blocks")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    met = packed.select("dim", "block", "data", other).select(
        "dim", "block", "data", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    suspects = met.groupBy("dim", "low", "high").applyInArrow(
        _suspects(threshold), "dim int, low long, high long, right boolean, id long"
    )
    suspects = write_shared(suspects, "vector-suspects")
    linked = write_shared(
        suspects.join(classes.select("id", "n", "vector"), "id")
        .groupBy("dim", "low", "high")
        .applyInArrow(_exact(threshold), "id long, partners long, root long"),
        "vector-links",
    )
    partners = linked.groupBy("id").agg(F.sum("partners").alias("partners"))
    owned = write_shared(
        rows.where("vector IS NOT NULL").join(classes.select("vector", "id"), "vector").select("key", "id"),
        "vector-owners",
    )
    # Rows of one key in several classes hold these together.
    first = owned.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"))
    same_key = owned.join(first.where("a <> z"), "key").select("a", F.col("id").alias("b"))
    known = connected_components(
        linked.select(F.col("root").alias("a"), F.col("id").alias("b")).union(same_key)
    )
    joined = write_shared(
        classes.join(partners, "id", "left")
        .join(known.withColumnRenamed("node", "id"), "id", "left")
        .select(
            F.col("vector").alias("v"),
            (F.col("n") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("root"),
            "least",
        ),
        "vector-components",
    )
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    found = joined.drop("least").join(least, "root")
    component = F.coalesce("component", "key")
    return rows.join(found, F.col("vector") == F.col("v"), "left").select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"),
    )
