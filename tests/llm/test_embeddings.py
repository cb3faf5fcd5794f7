from __future__ import annotations

import numpy as np
import pytest
from compare import connect, duck_rows, spark_rows
from pyspark.sql import functions as F

from starward.llm import embeddings
from starward.llm.embeddings import embedding_duplicates, links, quantised

from .test_near_duplicates import roots

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_force(rows, threshold):
    vectors = [(k, np.float32(v).astype(float) if usable(v) and k is not None else None) for k, v in rows]
    n_links, pairs = [0] * len(rows), []
    for i, (a, u) in enumerate(vectors):
        for j, (b, v) in enumerate(vectors[:i]):
            if u is not None and v is not None and len(u) == len(v):
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                    n_links[i] += 1
                    n_links[j] += 1
                    pairs.append((a, b))
    root = roots({k for k, _ in rows if k is not None}, pairs)
    return sorted(
        ((k, n, root.get(k), k is None or root[k] == k) for (k, _), n in zip(rows, n_links, strict=True)), key=str
    )


def found(spark, rows, threshold=0.9):
    frame = spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA)
    frame = frame.withColumn("n_links", F.lit("clash")).withColumn("block", F.lit(0))
    return sorted(map(tuple, embedding_duplicates(frame, threshold).collect()), key=str)


@pytest.mark.parametrize("block", [7, 4096])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    pick = np.random.default_rng(3)
    rows = []
    for _ in range(9):
        base = pick.normal(size=16)
        rows += [(len(rows) + k, (base + pick.normal(size=16) * 0.3).tolist()) for k in range(pick.integers(1, 9))]
        rows += [(len(rows) + k, rows[-1][1]) for k in range(pick.integers(0, 3))]
    assert found(spark, rows) == brute_force(rows, 0.9)


def test_edges(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [float("inf"), 1.0]),
        (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (12, [1e-30, 1e-31]),
        (13, [1e30, 1e29]), (13, [5.0, -5.0]), (14, [4.0, -4.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (15, [-1.0, 0.0]),
    ]
    assert found(spark, rows) == brute_force(rows, 0.9)
    assert found(spark, []) == []


def test_bound_holds_and_links_are_exact():
    pick = np.random.default_rng(1)
    for dim in (3, 64, 2100):
        u = pick.normal(size=(60, dim))
        u[30:] = u[:30] + pick.normal(size=(30, dim)) * 0.5
        u[0] *= 1e200
        u[1] *= 1e-200
        unit = u / np.abs(u).max(axis=1)[:, None]
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        q, s, length, error = quantised(unit)
        coarse = embeddings.product(q, q) * np.outer(s, s)
        assert (np.abs(unit @ unit.T - coarse) <= np.outer(length, error) + error[:, None] + 1e-9).all()
        for threshold in (0.5, 0.8, 0.895):
            a, b = links(u, u, threshold, True)
            i, j = np.nonzero(np.triu(unit @ unit.T >= threshold, 1))
            assert set(zip(a, b, strict=True)) == set(zip(i, j, strict=True))


def test_query_agrees_with_sql(spark):
    from starward.llm.queries import ORACLE, QUERIES

    folder, name = "/root/testdata/sf0.001", "op3_embedding_duplicates"
    assert spark_rows(QUERIES[name](spark, folder)) == duck_rows(connect(folder), ORACLE[name])
