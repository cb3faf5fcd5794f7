from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from starward.llm import licenses
from starward.llm.licenses import NOTICES, TEXTS, license_matches, notices


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(words[k : k + 3]) for k in range(len(words) - 2)]


def brute_force(rows, templates, containment=0.8):
    """Best containment of each template around any place of each document."""
    best = {}
    for key, text in rows:
        own = shingles(text)
        for name, template in templates:
            wanted = shingles(template)
            if not wanted or not set(wanted) & set(own):
                continue
            size, slack = len(wanted), math.ceil(len(wanted) * (1 - containment))
            for start in range(-size, len(own)):
                low = max(start - slack, 0)
                around = set(own[low : max(start + size + slack, 0)])
                share = len(around & set(wanted)) / len(set(wanted))
                if share >= containment:
                    best[key, name] = max(share, best.get((key, name), 0))
    return best


def collected(docs, templates):
    rows = license_matches(docs, templates).collect()
    assert len({(r.doc_id, r.license) for r in rows}) == len(rows)
    return {(r.doc_id, r.license): r.containment for r in rows}


def test_against_brute_force(spark, documents):
    pick = random.Random(2)
    vocabulary = sorted({w for text in NOTICES.values() for w in text.split()} | {f"w{k}" for k in range(300)})
    rows = []
    for key in range(400):
        body = pick.choices(vocabulary, k=pick.randint(0, 90))
        if key % 2:
            notice = pick.choice(list(NOTICES.values())).split()
            for _ in range(pick.choice([0, 0, 1])):
                notice[pick.randrange(len(notice))] = "changed"
            at = pick.randint(0, len(body))
            body[at:at] = notice
        rows.append((key, pick.choice([" ", ",\n"]).join(body)))
    got, want = collected(documents(rows), notices(spark)), brute_force(rows, list(NOTICES.items()))
    assert got.keys() <= want.keys()
    assert len(got) >= 0.98 * len(want)
    whole = {pair for pair, share in want.items() if share == 1}
    assert len(whole & got.keys()) >= 0.99 * len(whole)


@pytest.mark.parametrize("block", [50_000, 100])
def test_whole_texts_against_brute_force(spark, documents, monkeypatch, block):
    monkeypatch.setattr(licenses, "BLOCK", block)
    pick = random.Random(5)
    vocabulary = [f"w{k}" for k in range(200)]
    texts = TEXTS | {f"long-{k}": " ".join(pick.choices(vocabulary, k=700)) for k in range(2)}
    rows = []
    for key in range(60):
        body = pick.choices(vocabulary, k=pick.randint(0, 200))
        copy = pick.choice(list(texts.values())).split()
        for _ in range(len(copy) * (key % 4) // 50):
            copy[pick.randrange(len(copy))] = "changed"
        at = pick.randint(0, len(body))
        rows.append((key, " ".join(body[:at] + copy + body[at:])))
    templates = spark.createDataFrame(list(texts.items()), "license string, text string")
    got, want = collected(documents(rows), templates), brute_force(rows, list(texts.items()))
    assert got == want and len(want) > 45


def test_copies_of_a_long_text_are_confirmed_once_per_run(spark, documents):
    """Thousands of windows agree; the index is linear and the work too: quadratic, this would not end."""
    pick = random.Random(6)
    text = " ".join(f"w{n}" for n in pick.choices(range(3000), k=5000))
    rows = [(k, f"before it {text} after it") for k in range(200)]
    templates = spark.createDataFrame([("long", text)], "license string, text string")
    got = license_matches(documents(rows), templates).collect()
    assert {(r.license, r.containment, r.first_word, r.end_word) for r in got} == {("long", 1.0, 2, 5002)}
    assert len(got) == 200


def test_plan_stays_in_the_jvm_and_moves_no_text(spark, documents):
    plan = license_matches(documents([(1, "a b c")]), notices(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("text#" in line or "own#" in line for line in moved)


def test_edges(spark, documents):
    apache = NOTICES["Apache-2.0"]
    rows = [
        (1, None), (2, ""), (3, "two words"), (4, apache), (4, apache), (None, apache.upper() + "!"), (5, "x " * 20_000 + apache),
        (6, "License Apache the under Licensed"), (7, f"{apache} {apache}"), (8, "é " + apache.replace(" ", "\n")), (9, apache[:-12]),
    ]
    frame = documents(rows).withColumn("license", F.lit("clash")).withColumn("found", F.lit(1))
    templates = spark.createDataFrame([("a", apache), ("a", apache), ("b", None), ("c", "two words"), (None, apache)], "license string, text string")
    got = collected(frame, templates)
    assert set(got) == {(k, n) for k in (4, None, 5, 7, 8) for n in ("a", None)}
    assert set(got.values()) == {1.0}
    place = {r.doc_id: (r.first_word, r.end_word) for r in license_matches(frame, templates).collect()}
    assert place[4] == (0, 8) and place[8] == (1, 9) and place[5] == (20_000, 20_008)


def test_empty_tables(spark, documents):
    assert license_matches(documents([]), notices(spark)).collect() == []
    assert license_matches(documents([(1, NOTICES["MIT"])]), notices(spark).where("false")).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    from starward.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r.doc_id, r.license): r.containment for r in QUERIES["op2_license_scan"](spark, folder).collect()}
    assert got == brute_force(rows, list((NOTICES | TEXTS).items())) and got
