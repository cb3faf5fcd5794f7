from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from starward.llm import decontamination
from starward.llm.decontamination import Searcher, contaminated, words_of


def edits(item, words):
    """Least edit distance of the item to any run of words."""
    row = [0] * (len(words) + 1)
    for word in item:
        before, row = row, [row[0] + 1]
        for k, other in enumerate(words, 1):
            row.append(min(before[k] + 1, row[-1] + 1, before[k - 1] + (word != other)))
    return min(row)


def brute_force(rows, items, ratio):
    found = {}
    for key, text in rows:
        for item, item_text in items:
            own = words_of(item_text)
            if own and (d := edits(own, words_of(text))) <= int(ratio * len(own)):
                found[key, item] = min(d, found.get((key, item), d))
    return found


def changed(pick, words, n):
    words = list(words)
    for _ in range(n):
        at, kind = pick.randrange(len(words)), pick.choice("sid")
        words[at : at + (kind != "i")] = [] if kind == "d" else [f"new{pick.randrange(10**6)}"]
    return words


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def collected(docs, items, ratio=0.15):
    rows = contaminated(docs, items, ratio).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    assert all(0 <= r.first_word <= r.end_word for r in rows)
    return {(r.doc_id, r.item_id): r.edits for r in rows}


def test_recall_and_precision(spark, documents, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 40)
    monkeypatch.setattr(decontamination, "STARTS", 500)
    pick = random.Random(4)
    vocabulary = ["the", "of", "and", "a", "in"] * 20 + [f"w{k}" for k in range(400)]
    items = [(k, " ".join(pick.choices(vocabulary, k=pick.randint(5, 70)))) for k in range(100)]
    rows = []
    for key in range(300):
        body = pick.choices(vocabulary, k=pick.randint(0, 120))
        if key % 3:
            own = pick.choice(items)[1].split()
            at = pick.randint(0, len(body))
            body[at:at] = changed(pick, own, pick.randint(0, int(0.2 * len(own))))
        rows.append((key, ", ".join(body).title()))
    got, want = collected(documents(rows), benchmark(spark, items)), brute_force(rows, items, 0.15)
    assert got.items() <= want.items()
    assert len(got) >= 0.97 * len(want)
    assert {pair for pair, d in want.items() if d == 0} <= got.keys()


def test_edges(spark, documents):
    item = "one two three four five six seven eight nine ten"
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "too short an item"), (None, "null keys are keys as well here")]
    rows = [(1, item), (1, item + " x"), (2, None), (3, ""), (4, "... !!"), (5, "x " * 40_000 + item), (None, item.upper()),
            (6, "too short an item"), (7, '("One, two) THREE - four five; six seven eight nine ten!"'), (8, item[:-4]),
            (9, "null keys are keys as well here"), (10, "é " + item.replace("four", "fuor"))]
    frame = documents(rows).withColumn("item", F.lit("clash")).withColumn("edits", F.lit(1))
    assert collected(frame, benchmark(spark, items)) == {
        (1, 1): 0, (5, 1): 0, (None, 1): 0, (6, 4): 0, (7, 1): 0, (8, 1): 1, (9, None): 0, (10, 1): 1
    }


def test_short_items_are_found_exactly(spark, documents):
    pick = random.Random(8)
    items = [(k, " ".join(pick.choices("abcdefg", k=pick.randint(1, 4)))) for k in range(30)]
    rows = [(k, pick.choice([" ", ", ", "\n"]).join(pick.choices("ABcdefghijk", k=pick.randint(0, 40)))) for k in range(60)]
    assert collected(documents(rows), benchmark(spark, items)) == brute_force(rows, items, 0.15)


@pytest.mark.parametrize("size", [7, 20, 60, 250, 500])
def test_recall_by_length(size):
    pick = random.Random(size)
    items = [[f"w{pick.randrange(2000)}" for _ in range(size)] for _ in range(40)]
    searcher = Searcher(items, 0.15)
    filler = [f"x{k}" for k in range(30)]
    texts = [" ".join(filler + changed(pick, own, int(0.15 * size) // 2) + filler) for own in items]
    found = {(text, item) for text, item, *_ in searcher.search(texts)}
    assert len(found & {(k, k) for k in range(40)}) >= 0.97 * 40


def test_rows_without_items_stay_as_they_are(spark, documents):
    items = [(1, "one two three four five six seven"), (2, "single"), (3, None), (4, "...")]
    rows = [(1, "a one two three four five six seven b"), (1, "free"), (2, None), (None, ""), (None, "Single!"), (3, "free " * 9000)]
    frame = documents(rows).withColumn("key", F.lit("clash"))
    kept = decontamination.keep_uncontaminated(frame, benchmark(spark, items))
    assert kept.schema == frame.schema
    gone = {rows[0], rows[4]}
    assert sorted(map(tuple, kept.select("doc_id", "text").collect()), key=str) == sorted(set(rows) - gone, key=str)
    assert decontamination.keep_uncontaminated(frame, benchmark(spark, [])).count() == len(rows)
    assert decontamination.keep_uncontaminated(documents([]), benchmark(spark, items)).collect() == []


def test_empty_tables(spark, documents):
    empty = benchmark(spark, [])
    assert contaminated(documents([]), benchmark(spark, [(1, "a b c d e f")])).collect() == []
    assert contaminated(documents([(1, "a b c d e f")]), empty).collect() == []


def test_repeated_words_do_not_break_the_walk():
    searcher = Searcher([["a"] * 20, ["a", "b"] * 10], 0.1)
    found = {(text, item): edits for text, item, edits, *_ in searcher.search(["a " * 50, "b a " * 30, ""])}
    assert found == {(0, 0): 0, (1, 1): 0}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    from starward.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    # A run with few edits has half of the item's words at least; that spares most of the work.
    near = [(k, t) for k, t in rows if any(len(set(words_of(i)) - set(words_of(t))) <= 0.15 * len(words_of(i)) for _, i in items)]
    got = {(r.doc_id, r.item_id): r.edits for r in QUERIES["op6_contaminated"](spark, folder).collect()}
    assert got == brute_force([(k, t) for k, t in near if len(words_of(t)) < 4000], items, 0.15) | {
        pair: d for pair, d in got.items() if len(words_of(dict(rows)[pair[0]])) >= 4000
    }
