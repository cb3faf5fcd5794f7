from __future__ import annotations

import hashlib
import random
from collections import Counter
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from starward.llm import fingerprints as fp
from starward.llm.fingerprints import digests, edited, edited_likeness, entropies, features, likeness, rarity


def plain_entropy(window):
    """In thousandths, from the same whole numbers."""
    terms = [round(n * log2(max(n, 1)) * fp.SCALE) for n in range(65)]
    return (terms[64] - sum(terms[n] for n in Counter(window).values())) * 1000 // terms[64]


def plain_features(text, ranks):
    """Windows with enough points, one after the other."""
    data = text.encode()
    windows = [data[k : k + 64] for k in range(len(data) - 63)]
    if not windows:
        return [data] if data else []
    score = [ranks[plain_entropy(w)] for w in windows]
    width = min(64, len(windows))
    points = Counter(min(range(k, k + width), key=lambda i: (score[i], i)) for k in range(len(windows) - width + 1))
    needed = min(16, len(windows) - width + 1)
    return list(dict.fromkeys(windows[k] for k in sorted(points) if points[k] >= needed))


def sentences(pick, n):
    return " ".join("".join(pick.choices("etaoinshrdlucmfw", k=pick.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(5)
    return [sentences(pick, pick.randint(0, 400)) for _ in range(40)] + ["", "x", "a" * 500, "é" * 40, "ab" * 63, "z" * 64, "0123456789" * 13]


def test_entropies_of_sliding_windows(monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", 50)
    data = bytes(random.Random(1).choices(b"aaaabcdefgh\xff\x00", k=700)) + b"a" * 100
    got = entropies(np.frombuffer(data, np.uint8)).tolist()
    assert got == [plain_entropy(data[k : k + 64]) for k in range(len(data) - 63)]
    assert got[-1] == 0 and len(entropies(np.zeros(63, np.uint8))) == 0
    assert entropies(np.arange(64, dtype=np.uint8)).tolist() == [1000]


def test_features_are_the_rarest_windows(texts):
    ranks = np.array(random.Random(2).sample(range(1001), 1001))
    got = features([t.encode() for t in texts], ranks)
    for text, own in zip(texts, got, strict=True):
        expected = plain_features(text, ranks)
        assert len(own) == len(expected)
        alone = features([text.encode()], ranks)[0]
        assert own.tolist() == alone.tolist()
        full = [w for w in expected if len(w) == 64]
        if full:
            assert own.tolist() == fp._hashed(np.frombuffer(b"".join(full), np.uint8).reshape(-1, 64)).tolist()


def test_rarity_counts_all_windows(documents, texts):
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, None)]
    counts = Counter(plain_entropy(t.encode()[k : k + 64]) for t in texts for k in range(len(t.encode()) - 63))
    order = sorted(range(1001), key=lambda b: (b < 100, counts[b], b))
    ranks = rarity(documents(rows))
    assert [ranks[b] for b in order] == list(range(1001))
    assert rarity(documents([])) == rarity(documents([(1, "short")]))


def plain_likeness(a, b):
    """Filter by filter, from sets of bits."""
    def chain(text):
        n, raw = int(text.split(":")[0]), fp.base64.b64decode(text.split(":")[1])
        parts = [int.from_bytes(raw[k : k + 256], "big") for k in range(0, len(raw), 256)]
        return [(min(160, n - 160 * k), bits) for k, bits in enumerate(parts)]

    def alike(x, y):
        (n, f), (m, g) = x, y
        most, empty = min(f.bit_count(), g.bit_count()), 1 - 1 / 2048
        chance = 2048 * (1 - empty ** (5 * n) - empty ** (5 * m) + empty ** (5 * n + 5 * m))
        floor = chance + 0.1 * (most - chance)
        return min(max(((f & g).bit_count() - floor) / max(most - floor, 1e-9), 0), 1)

    if a == b:
        return 1.0
    one, other = sorted((chain(a), chain(b)), key=lambda c: (len(c), sum(n for n, _ in c)))
    return sum(max(alike(x, y) for y in other) * x[0] for x in one) / sum(n for n, _ in one) if one else 0.0


def test_likeness(monkeypatch):
    monkeypatch.setattr(fp, "COMPARED", 3)
    pick, ranks = random.Random(3), np.arange(1001)
    base = sentences(pick, 9000)
    other = sentences(pick, 5000)
    half = edited(base, other)
    a, b, c, d, none = digests([base, other, half, base[20000:30000], ""], ranks)
    assert int(a.split(":")[0]) > 800
    for x, y in ((a, b), (a, c), (c, b), (a, d), (none, a)):
        assert likeness(x, y) == pytest.approx(plain_likeness(x, y), abs=1e-6) == pytest.approx(likeness(y, x))
    assert likeness(a, a) == likeness(none, none) == 1.0 and likeness(none, a) == 0.0
    assert likeness(a, b) < 0.02 and 0.4 < likeness(a, c) < 0.7 and likeness(a, d) > 0.4


def brute_force(frame):
    ranks = np.array(rarity(frame))
    rows = [(r.doc_id, r.text or "") for r in frame.withColumn("h", F.xxhash64("text")).orderBy(F.desc_nulls_last("doc_id"), "h").collect()]
    made = []
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = edited(text, following)
        own, new, after = (digests([t], ranks)[0] for t in (text, changed, following))
        made.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, new, likeness(own, new), likeness(own, after)))
    return sorted(made, key=str)


def found(frame):
    return sorted(map(tuple, edited_likeness(frame).collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 8])
def test_against_brute_force(spark, documents, conf, texts, partitions):
    conf("spark.sql.shuffle.partitions", str(partitions))
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(pick, text) for pick, text in zip(random.Random(6).sample(range(1000), len(texts)), texts, strict=True)]
    frame = documents(rows)
    assert found(frame) == brute_force(frame)


def test_edges(documents, conf):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    long = sentences(random.Random(9), 60_000)
    rows = [(1, None), (2, ""), (3, long), (None, "null key"), (None, "other null key"), (4, "é" * 99), (4, "tie of one key"), (5, long), *[(7, "same row")] * 9]
    frame = documents(rows).withColumn("key", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("hash", F.lit(1))
    assert found(frame) == brute_force(frame)
    one = documents([(1, "only one document")])
    assert found(one) == brute_force(one) and found(one)[0][-1] == 1.0


def test_empty_table(documents):
    assert found(documents([])) == []
    assert fp.fingerprints(documents([])).collect() == []


def test_fingerprints_alone(documents, texts):
    rows = [(k % 7, t) for k, t in enumerate(texts)] + [(None, None)]
    frame = documents(rows)
    ranks = np.array(rarity(frame))
    got = sorted(map(tuple, fp.fingerprints(frame).collect()), key=str)
    assert got == sorted(((k, len(t or ""), digests([t or ""], ranks)[0]) for k, t in rows), key=str)


def test_query(spark):
    from starward.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op13_fingerprints"](spark, folder).collect()), key=str)
    assert got == brute_force(frame)
    mean = [sum(row[k] for row in got) / len(got) for k in (5, 6)]
    assert mean[0] > 0.4 and mean[1] < 0.1
