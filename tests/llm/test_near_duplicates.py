from __future__ import annotations

import random

import numpy as np
import pytest
from compare import connect, duck_rows, spark_rows
from pyspark.sql import functions as F

from starward.llm.components import connected_components
from starward.llm.near_duplicates import bands_for, near_duplicates, shingle_sets, sketch


def shingles(text, words):
    own = (text or "").encode().lower().split()
    if not own:
        return set()
    return {tuple(own[k : k + words]) for k in range(max(len(own) - words, 0) + 1)}


def roots(nodes, links):
    parent = {node: node for node in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {node: find(node) for node in nodes}


def brute_force(rows, words, percent):
    sets = [(key, shingles(text, words)) for key, text in rows]
    links = [
        (a, b)
        for i, (a, x) in enumerate(sets)
        for b, y in sets[:i]
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    root = roots({key for key, _ in rows if key is not None}, links)
    return sorted(((k, len(s), root.get(k), k is None or root[k] == k) for k, s in sets), key=str)


def found(frame, words, percent):
    return sorted(map(tuple, near_duplicates(frame, words, percent).collect()), key=str)


def altered(pick, words, changes):
    words = list(words)
    for _ in range(changes):
        words[pick.randrange(len(words))] = str(pick.random())
    return words


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(documents, words, percent):
    pick = random.Random(words)
    rows = []
    for _ in range(12):
        base = [pick.choice("abcdefghijklm") + str(pick.randint(0, 30)) for _ in range(pick.randint(5, 250))]
        for _ in range(pick.randint(1, 14)):
            rows.append((len(rows), " ".join(altered(pick, base, pick.randint(0, 4)))))
            base = altered(pick, base, pick.randint(0, 2))
    assert found(documents(rows), words, percent) == brute_force(rows, words, percent)


def test_edges(documents):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, "one two "),
        (9, "É one"), (10, "é one"), (11, long), (12, long + " x"), (13, "a b c d"), (13, "e f g h"), (14, "E F G H"),
        (15, "a b c d"), (None, "one"), (None, None), (16, "a\x1cb c d"), (16, "a\x1cb c d"),
    ]
    frame = documents(rows).withColumn("kept", F.lit("clash")).withColumn("rep", F.lit(1))
    assert found(frame, 3, 85) == brute_force(rows, 3, 85)


def test_empty_table(documents):
    assert found(documents([]), 3, 85) == []


def test_a_chain_of_near_copies_is_one_component(documents):
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join([*base[:k], *(f"x{j}" for j in range(k, k + 2)), *base[k + 2 :]])) for k in range(0, 90, 3)]
    rows += [(1000 + k, " ".join(f"y{k}-{j}" for j in range(40))) for k in range(5)]
    assert found(documents(rows), 3, 85) == brute_force(rows, 3, 85)


def test_the_estimate_is_close():
    pick, registers = np.random.default_rng(5), bands_for(0.85) * 6
    common, left, right = (pick.integers(0, 2**63, n).astype(np.uint64) for n in (9000, 500, 500))
    sketches = [sketch(np.unique(np.concatenate([common, own])), registers) for own in (left, right)]
    assert abs((sketches[0] == sketches[1]).mean() - 0.9) < 0.1


def test_sets_have_the_true_sizes():
    texts = [b"", b"a", b"a b", b"a b c", b"a a a a a", b"a b c a b c"]
    assert [len(own) for own in shingle_sets(texts, 3)] == [0, 1, 1, 1, 1, 3]


def test_components(spark):
    pick = random.Random(3)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)]
    links += [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(1900, 2100)] + [(5, None)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert dict(map(tuple, got)) == roots({n for pair in real for n in pair}, real)
    assert len(got) == len({row.node for row in got})


def test_query_agrees_with_sql(spark):
    from starward.llm.queries import ORACLE, QUERIES

    folder, name = "/root/testdata/sf0.001", "op8_near_duplicates"
    assert spark_rows(QUERIES[name](spark, folder)) == duck_rows(connect(folder), ORACLE[name])
