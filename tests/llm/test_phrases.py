from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, duck_rows, spark_rows
from pyspark.sql import functions as F

from starward.llm import phrases
from starward.llm.packing import pack, together
from starward.llm.phrases import collocations
from starward.sources.shared import shared_folder


def brute_force(rows, least, longest=5, reported=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for at in range(len(words) - size + 1):
                    counts[lang, tuple(words[at : at + size])] += 1
    counts = {key: n for key, n in counts.items() if n >= least}
    made = {}
    for (lang, phrase), a in counts.items():
        if len(phrase) < 2:
            continue
        cuts = []
        for k in range(1, len(phrase)):
            left, right = counts[lang, phrase[:k]], counts[lang, phrase[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        inside = [
            n for (other, longer), n in counts.items()
            if other == lang and len(longer) > len(phrase)
            and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))
        ]
        if max(inside, default=0) < a:
            made.setdefault(lang, []).append((" ".join(phrase), a, *min(cuts)))
    result = []
    for lang, own in made.items():
        own.sort(key=lambda c: (-c[2], -c[1], c[0].encode()))
        result += [(lang, k, p, a, left, right, totals[lang], score) for k, (p, a, score, _, left, right) in enumerate(own[:reported], 1)]
    return sorted(result)


def found(frame, least, **more):
    return sorted(map(tuple, collocations(frame, least=least, **more).collect()))


@pytest.fixture
def texts(spark):
    def build(rows, partitions=3):
        return spark.createDataFrame(rows, "text string, lang string").repartition(partitions)

    return build


@pytest.mark.parametrize(("side", "dense", "strip"), [(1024, 1 << 14, 1 << 18), (3, 5, 2)])
def test_against_brute_force(texts, monkeypatch, side, dense, strip):
    """Tiles, strips and rounds of any size give the same counts."""
    for name, value in {"SIDE": side, "DENSE": dense, "STRIP_PAIRS": strip, "MERGED": 2, "CHUNK_BYTES": 300}.items():
        monkeypatch.setattr(phrases, name, value)
    pick = random.Random(side)
    fixed = ["new york city", "in the end of the", "a a a a a a", "to be or not", "x y"]
    rows = []
    for _ in range(80):
        words = [w for _ in range(12) for w in (pick.choice(fixed).split() if pick.random() < 0.4 else [pick.choice("abcdefgh")])]
        text = "".join(w + pick.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " é "]) for w in words)
        rows.append((text.title() if pick.random() < 0.1 else text, pick.choice(["en", "en", "de", None])))
    expected = brute_force(rows, 6)
    assert found(texts(rows), 6) == expected
    assert found(texts(rows), 6, reported=3) == [r for r in expected if r[1] <= 3]
    assert {len(r[2].split()) for r in expected} == {2, 3, 4, 5}


def test_edges(texts):
    rows = [
        (None, "en"), ("", None), (" \t\n.,", "en"), ("one", "xx"), ("a b " * 5000, None), ("A\x1cb c\x00d é é", "en"),
        ("A\x1cb c\x00d é é", "en"), ("x! y x y; x\ty", "und"), ("no end " * 20000 + ".", "long"),
    ]
    frame = texts(rows).withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("id", F.lit(2))
    assert found(frame, 2) == brute_force(rows, 2)


def test_nothing_is_frequent(texts):
    assert found(texts([]), 2) == []
    assert found(texts([("every word is rare", "en")]), 2) == []
    assert found(texts([("same same. same", "en")]), 2) == []


def test_scores_may_pass_64_bits(spark):
    rows = [("en", "a", 1, 10**13), ("en", "b", 1, 10**13), ("en", "a b", 2, 10**13 - 7)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, size int, n long")
    totals = spark.createDataFrame([("en", 10**16 + 1)], "lang string, total long")
    assert phrases.scored(counts, totals).first().score == 1000 * (10**13 - 7) * (10**16 + 1) // 10**26


def test_dense_tiles_are_those_most_pairs_fall_on():
    first = np.concatenate([np.zeros(50, np.int64), np.arange(5000) * 2000])
    second = np.concatenate([np.arange(50) % 7, np.arange(5000)])
    made = list(phrases.tiles(first, second, np.array([0]), 8, 1024))
    assert [(row, column) for row, column, *_ in made if column >= 0] == [(0, 0)]
    assert sum(counts.sum() for *_, counts in made) == 5050
    finer = [(r, c) for r, _, c, n in made if _ < 0 for r2, _, c2, _ in phrases.dealt(*c, n, 64) if r2 % 8 != r]
    assert finer == []


def test_words_outside_frequent_phrases_become_one_break():
    words, phrases_ = np.arange(10), np.array([-1, 7, -1, -1, -1, -1, 8, 9, -1, -1])
    kept, starts = phrases.covered(words, phrases_, 2)
    assert kept.tolist() == [1, 2, -1, 6, 7, 8, -1] and starts.tolist() == [7, -1, -1, 8, 9, -1, -1]
    assert [x.tolist() for x in phrases.covered(words, np.full(10, -1), 2)] == [[], []]


def test_tile_sizes_follow_the_pairs_and_not_the_plane():
    """Frequent words spread over a large plane make no row per tile."""
    words = np.random.default_rng(1).integers(0, 1 << 20, 20000)
    words[::50] = 7
    words[1::50] = 8
    row = pa.RecordBatch.from_pylist([{"chunk": 1, "words": pack(words), "phrases": b""}])
    made = [pair for batch in phrases._tile_sizes(1024, 100)(iter([row])) for pair in zip(*batch.to_pydict().values(), strict=True)]
    assert len(made) == 1 and made[0][0] == 0 and made[0][1] >= 400


def test_places_move_once(texts, monkeypatch):
    """Only ids of words come back to the chunks; phrases are marked where their chunk is."""
    moved = []
    monkeypatch.setattr(phrases, "together", lambda frames: moved.append(1) or together(frames))
    rows = [("so it is and so it goes on", "en")] * 4
    assert found(texts(rows), 2) == brute_force(rows, 2)
    assert len(moved) == 1


def test_a_full_sieve_changes_nothing(spark, texts, monkeypatch):
    """What passes in error, here everything, is counted and dropped."""
    marks = spark.sparkContext.broadcast(np.full(phrases.SIEVE // 8, 255, np.uint8))
    monkeypatch.setattr(phrases, "sieve", lambda *of: marks)
    pick = random.Random(4)
    rows = [(" ".join(pick.choice("aabcde.") for _ in range(60)), pick.choice(["en", "de"])) for _ in range(40)]
    assert found(texts(rows), 9) == brute_force(rows, 9)


def test_longer_phrases_are_counted_word_by_word():
    """Ids beyond 31 bits, too; sums are those of equal phrases."""
    pick = np.random.default_rng(2)
    columns = [pick.choice([0, 5, 1 << 31, (1 << 40) + 5], 3000) for _ in range(5)]
    counts = pick.integers(1, 9, 3000)
    expected = Counter()
    for *phrase, n in zip(*columns, counts, strict=True):
        expected[tuple(map(int, phrase))] += int(n)
    ids, total = phrases.distinct(columns, counts)
    assert list(zip(zip(*map(np.ndarray.tolist, ids), strict=True), total.tolist(), strict=True)) == sorted(expected.items())
    single = phrases.distinct(columns)[1]
    assert single.sum() == 3000 and len(single) == len(expected)


def test_words_come_once_per_chunk(texts):
    """However often places are handed over, the words of a language are not repeated."""
    rows = [("many words of one language here", "en")] * 100 + [("few", "de"), ("some", None)] * 3
    made = texts(rows, 1).coalesce(1).select("lang", "text").mapInArrow(
        phrases._chunks(500), "chunk long, lang string, n_words long, words array<string>, counts binary, places binary"
    )
    made = made.collect()
    assert Counter(row.lang for row in made if row.words) == {"en": 1, "de": 1, None: 1}
    assert sum(row.places is not None for row in made if row.lang == "en") >= 5
    assert sum(row.n_words or 0 for row in made) == 100 * 6 + 6


@pytest.mark.parametrize("most", [0, 3])
def test_words_outside_the_head_come_by_the_join(texts, monkeypatch, most):
    monkeypatch.setattr(phrases, "HEAD", most)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 100)
    pick = random.Random(most)
    long = "long" * 50
    rows = [(" ".join(pick.choice([*"aabcde.", long]) for _ in range(60)), pick.choice(["en", "de", None])) for _ in range(40)]
    assert found(texts(rows), 9) == brute_force(rows, 9)


def test_ids_of_the_most_frequent_words_are_not_joined(texts, monkeypatch):
    """They go to all tasks; else nearly every chunk has a row for each of them."""
    moved = []
    monkeypatch.setattr(phrases, "together", lambda frames: moved.append(frames[1].count()) or together(frames))
    rows = [("so it is and so it goes on " + "x" * 65, "en")] * 4
    assert found(texts(rows, 1), 2) == brute_force(rows, 2)
    assert moved == [1]  # the word longer than those of the head
    monkeypatch.setattr(phrases, "HEAD", 0)
    assert found(texts(rows, 1), 2) == brute_force(rows, 2)
    assert moved == [1, 7]


def test_no_stage_calls_python_twice(texts, monkeypatch):
    """Every call takes a worker, which stays beside the executor's heap."""
    stages, write = [], phrases.write_shared

    def written(df, label):
        names = re.findall(r"InArrow|Exchange|Scan", df._jdf.queryExecution().executedPlan().toString())
        stages.extend(s.count("InArrow") for s in re.split("Exchange|Scan", "".join(names)))
        return write(df, label)

    monkeypatch.setattr(phrases, "write_shared", written)
    for merged in (2, 256):
        monkeypatch.setattr(phrases, "MERGED", merged)
        monkeypatch.setattr(phrases, "CHUNK_BYTES", 40)
        rows = [("so it is and so it goes on", "en")] * 40
        assert found(texts(rows), 2) == brute_force(rows, 2)
    assert max(stages) == 1


def test_only_the_result_stays(spark, texts):
    from starward.sources.shared import write_result

    place = Path(shared_folder(spark).removeprefix("file:")) / "starward"
    before = set(place.iterdir()) if place.exists() else set()
    write_result(spark, lambda: collocations(texts([("so it is so it is", "en")] * 3), least=2), "phrases").count()
    assert len(set(place.iterdir()) - before) == 1


def test_query_agrees_with_sql(spark):
    from starward.llm.queries import ORACLE, QUERIES

    folder, name = "/root/testdata/sf0.01", "op12_collocations"
    assert spark_rows(QUERIES[name](spark, folder)) == duck_rows(connect(folder), ORACLE[name])
