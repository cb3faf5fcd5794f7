from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest
from compare import connect, duck_rows, spark_rows
from pyspark.sql import functions as F

from starward.llm import spelling
from starward.llm.spelling import near_words, spelling_variants, word_counts
from starward.sources.shared import shared_folder


def counted(rows, shortest=7):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if key is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= shortest and n >= 2}


def neighbours(words):
    """Pairs within one edit, from shortened forms."""
    near, cut = {word: set() for word in words}, {}
    for word in words:
        for k in range(len(word)):
            short = word[:k] + word[k + 1 :]
            if short in near:
                near[word].add(short)
                near[short].add(word)
            cut.setdefault((k, short), []).append(word)
    for alike in cut.values():
        for word in alike:
            near[word].update(alike)
    return {word: own - {word} for word, own in near.items()}


def brute_force(rows):
    n = counted(rows)
    near, form = neighbours(n), {}
    for word, own in near.items():
        best = min(own, key=lambda w: (-n[w], w), default=None)
        form[word] = best if best is not None and n[best] >= 10 * n[word] else None
    made = []
    for word in n:
        root = word
        while form[root] is not None:
            root = form[root]
        made.append((word, form[word], root, n[word], len(near[word]), n.get(form[word])))
    return sorted(made)


def found(frame):
    return sorted(map(tuple, spelling_variants(frame).collect()))


def misspelt(pick, word):
    at, letter = pick.randrange(len(word) + 1), pick.choice("abcdeéÀ")
    return pick.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]])


def test_against_brute_force(documents, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 12)
    pick = random.Random(4)
    base = ["".join(pick.choice("abcdeéÀ") for _ in range(pick.randint(6, 14))) for _ in range(40)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa"]
    rows = []
    for key in range(150):
        own = [pick.choice(base) for _ in range(40)]
        own = [misspelt(pick, w) if pick.random() < 0.2 else w for w in own]
        own = [misspelt(pick, w) if pick.random() < 0.1 else w.upper() if pick.random() < 0.1 else w for w in own]
        rows.append((key, pick.choice([" ", "\n", "1", " - "]).join(own)))
    rows += [(500 + k, " ".join([base[0]] * 300)) for k in range(4)]
    expected = brute_force(rows)
    assert found(documents(rows)) == expected
    assert any(form for _, form, *_ in expected) and any(near > 3 for *_, near, _ in expected)


def test_forms_are_followed_to_the_last(documents):
    words = {"abcdefgh": 3000, "abcdefgx": 250, "abcdefxx": 20, "abcdexxx": 2, "zzzzzzzz": 2}
    rows = [(None, " ".join([word] * n)) for word, n in words.items()]
    got = {r[0]: r[1:3] for r in found(documents(rows))}
    assert got["abcdexxx"] == ("abcdefxx", "abcdefgh") and got["abcdefgh"] == (None, "abcdefgh")
    assert got["zzzzzzzz"] == (None, "zzzzzzzz")
    assert found(documents(rows)) == brute_force(rows)


@pytest.mark.parametrize("long", [7, 9, 12])
def test_long_words_are_matched_without_the_trie(spark, monkeypatch, long):
    """The two ways meet at any length."""
    monkeypatch.setattr(spelling, "LONG", long)
    pick = random.Random(long)
    words = {"".join(pick.choice("abé") for _ in range(pick.randint(7, 13))) for _ in range(1500)}
    got = near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    pairs = {(r.a, r.b) for r in got}
    assert len(got) == len(pairs)
    assert pairs == {(a, b) for a, own in neighbours(words).items() for b in own}


def test_edges(documents):
    run = "".join(random.Random(1).choices("abcdefgh", k=2000))
    rows = [
        (1, None), (2, ""), (3, "short words"), (None, "wordless wordless Wordless"), (4, "wordles wordles wordless"),
        (4, "wordles wordles wordless"), (5, f"{run} {run}"), (5, f"{run[:-1]} {run[:-1]} {run}x {run}x"),
        (6, "ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ àéîõüßÿ àéîõüßÿ"), (7, "ŁukaszŁukasz ŁukaszŁukasz"), (8, "x×÷×÷×÷ x×÷×÷×÷ x×÷×÷×y x×÷×÷×y"),
    ]
    frame = documents(rows).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("key", F.lit("k"))
    assert found(frame) == brute_force(rows)


def test_empty_table(documents):
    assert found(documents([])) == []
    assert word_counts(documents([])).collect() == []


def test_states_start_deep_in_the_trie(spark):
    """Words that all share their first letters make no more states than others."""
    words = [("common" + "".join(p),) for p in zip(*[iter(random.Random(2).choices("abcdefghijklmnop", k=9000))] * 3)]
    strand = spelling.strands(spark.createDataFrame(set(words), "word string"))
    edges = spelling.trie_edges(strand, 3)
    at = strand.where("start <= 4 AND length(own) > 4").select("own", "side", F.lit(0).alias("edits"), spelling._node(F.lit(4)).alias("node"))
    states = spelling._level(at, edges.where("depth = 4"), 4)
    assert states.where("side = 0").count() == 0
    assert states.count() <= 2 * len(set(words))


def test_only_the_result_stays(spark, documents):
    from starward.llm.queries import write_result

    place = Path(shared_folder(spark).removeprefix("file:")) / "starward"
    before = set(place.iterdir()) if place.exists() else set()
    frame = documents([(k, "spelling spellings spelling") for k in range(5)])
    write_result(spark, lambda: spelling_variants(frame), "spelling").count()
    assert len(set(place.iterdir()) - before) == 1


def test_query_agrees_with_sql(spark):
    from starward.llm.queries import ORACLE, QUERIES

    folder, name = "/root/testdata/sf0.001", "op11_spelling_variants"
    assert spark_rows(QUERIES[name](spark, folder)) == duck_rows(connect(folder), ORACLE[name])
