from __future__ import annotations

import random

import pytest
from compare import connect, duck_rows, spark_rows
from pyspark.sql import functions as F

from starward.llm import packing, repeats
from starward.llm.repeats import cut_repeats


def brute_force(rows, window):
    words = [(key, (text or "").encode().split()) for key, text in rows]
    order = [(float("inf") if key is None else key, own) for key, own in words]
    first = {}
    for key, own in order:
        for at in range(len(own) - window + 1):
            own_key = tuple(own[at : at + window])
            first[own_key] = min(first.get(own_key, key), key)
    made = []
    for (key, own), (rank, _) in zip(words, order, strict=True):
        gone = set()
        for at in range(len(own) - window + 1):
            if first[tuple(own[at : at + window])] < rank:
                gone |= set(range(at, at + window))
        kept = b" ".join(w for k, w in enumerate(own) if k not in gone).decode()
        made.append((key, len(own), len(gone), kept))
    return sorted(made, key=str)


def found(frame, window):
    rows = cut_repeats(frame, window).collect()
    for row in rows:
        assert sum(r.end - r.first for r in row.repeats) == row.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=str)


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_against_brute_force(documents, monkeypatch, window):
    monkeypatch.setattr(repeats, "CHUNK_CHARS", 300)
    pick = random.Random(window)
    shared = [[pick.choice("abcdefgh") for _ in range(pick.randint(3, 40))] for _ in range(6)]
    rows = []
    for key in range(60):
        own = []
        for _ in range(pick.randint(0, 4)):
            own += pick.choice(shared) if pick.random() < 0.6 else [str(pick.random()) for _ in range(9)]
        rows.append((key, " \n".join(own)))
    assert found(documents(rows), window) == brute_force(rows, window)


def test_edges(documents):
    passage = " ".join(f"w{k}" for k in range(20))
    rows = [
        (5, passage), (5, passage), (None, passage), (None, passage), (9, None), (8, ""), (7, " \t\n"),
        (6, "x " * 2000), (1, "é z " * 30), (2, "é z " * 14), (3, f"a {passage} b\x1cc"),
        *((100 + k, "same words in many documents again and again until it is long enough") for k in range(40)),
    ]
    frame = documents(rows).withColumn("kept", F.lit("clash")).withColumn("bucket", F.lit(1))
    assert found(frame, 13) == brute_force(rows, 13)


def test_empty_table(documents):
    assert cut_repeats(documents([])).collect() == []


def test_packing_round_trip():
    import numpy as np

    values = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    assert (packing.unpack_sorted(packing.pack_sorted(values), np.uint64) == values).all()
    assert packing.unpack_strings(packing.pack_strings([b"", b"a\0b", b""])) == [b"", b"a\0b", b""]
    assert packing.unpack_strings(packing.pack_strings([])) == []
    assert len(packing.unpack(packing.pack(values[:0]), np.uint64)) == 0


def test_query_agrees_with_sql(spark):
    from starward.llm.queries import ORACLE, QUERIES

    folder, name = "/root/testdata/sf0.001", "op7_cut_repeats"
    assert spark_rows(QUERIES[name](spark, folder)) == duck_rows(connect(folder), ORACLE[name])
