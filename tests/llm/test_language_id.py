from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from starward.llm import language_id
from starward.llm.language_id import COMPARED, PROFILE, Profiles, code, identify, learn_profiles


def grams(text):
    found = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        whole = f"_{word}_"
        for n in (1, 2, 3):
            for k in range(len(whole) - n + 1):
                if whole[k : k + n] != "_":
                    found[whole[k : k + n]] += 1
    return found


def brute_force(text, profiles, compared):
    own = sorted(grams(text).items(), key=lambda g: (-g[1], code(g[0])))[:compared]
    missing = max((len(p) for p in profiles.values()), default=0)
    if not own or not profiles:
        return "und", 0.0
    distance = {
        name: sum(min(abs(k - profile.index(g)), missing) if g in profile else missing for k, (g, _) in enumerate(own))
        for name, profile in profiles.items()
    }
    best = min(sorted(distance), key=distance.get)
    return best, 1 - distance[best] / (len(own) * missing)


TEXTS = [None, "", " 12 .,! ", "a", "don't STOP", "été à la plage", "x" * 3000, "the the the of of and", "中文 字", "a1b2c3 é", "_ _a_", "😀",
         "the plague of the thing and the rest " * 400]
PROFILES = {"en": ["_", "t", "th", "the", "_t", "e_", "o"], "fr": ["é", "la", "_l", "a", "a_", "t"]}


def same(got, want):
    return got[0] == want[0] and abs(got[1] - want[1]) < 1e-12


@pytest.mark.parametrize("compared", [3, 50])
@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_prediction_against_brute_force(monkeypatch, compared, cells):
    monkeypatch.setattr(language_id, "CELLS", cells)
    profiles = {name: [g for g in own if g != "_"] for name, own in PROFILES.items()}
    got = zip(*Profiles(profiles).predict([t or "" for t in TEXTS], compared), strict=True)
    assert all(same(g, brute_force(t, profiles, compared)) for g, t in zip(got, TEXTS, strict=True))


def test_learned_profiles(spark):
    rows = [("en", "The thing, the THE"), ("en", "of it"), ("fr", "été l'été"), (None, "zzz zzz"), ("de", None), ("xx", "...")]
    frame = spark.createDataFrame(rows, "lang string, text string")
    for size in (3, 400):
        profiles = learn_profiles(frame, size=size)
        want = {
            name: [g for g, _ in sorted((grams(" ".join(t for lang, t in rows if lang == name))).items(), key=lambda g: (-g[1], g[0]))][:size]
            for name in ("en", "fr")
        }
        assert profiles == want
    assert learn_profiles(frame.where("false")) == {}


def test_rows(documents):
    profiles = {"en": ["t", "th", "the"], "fr": ["é", "la"]}
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "la")]
    frame = documents(rows).withColumn("lang_pred", F.lit("clash"))
    got = sorted(map(tuple, identify(frame, profiles).collect()), key=str)
    want = sorted(((k, *brute_force(t, profiles, COMPARED)) for k, t in rows), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(same(g[1:], w[1:]) for g, w in zip(got, want, strict=True))
    assert {r.lang_pred for r in identify(frame, {}).collect()} == {"und"}
    assert identify(documents([]), profiles).collect() == []


def test_query_is_right_on_what_it_has_not_seen(spark):
    from starward.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op1_language_id"](spark, folder).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    unseen = [r for r in got if r.held_out and truth[r.doc_id].lang]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in unseen) >= 0.97 * len(unseen)


def test_profile_sizes():
    assert PROFILE >= COMPARED
