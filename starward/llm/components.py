"""Connected components of a graph given as edges, for graphs that no single task can hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starward.llm.packing import stored
from starward.sources.shared import write_shared


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node's neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked with the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(least, "u")
        .select(F.col("v").alias("a"), F.col("m").alias("b"))
        .union(least.select("u", "m"))
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    ``edges`` has integer columns a and b; loops, repeated edges and nulls are allowed (a null
    links nothing). Rounds of the public large-star, small-star method, each written to the shared
    folder, until a round changes nothing; every node then points at its component. Nodes of many
    edges are aggregated before the shuffle, and their joins can be split.
    """
    now = write_shared(edges.where("a <> b").select("a", "b").distinct(), "edges")
    seen, width = None, 16
    while True:
        state = now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        stars = _small_star(_large_star(now).where("a <> b").distinct())
        now = stored(stars.where("a <> b").distinct(), "edges", 2 * state[0], width)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def local_roots(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The smallest place reachable from each of ``nodes`` places by the links a-b, in one task."""
    root, before = np.arange(nodes), None
    while before is None or (root != before).any():
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
    return root
