from __future__ import annotations

from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from starward.llm.decontamination import keep_uncontaminated
from starward.llm.language_id import keep_identified, learn_profiles
from starward.sources.shared import shared_folder

from . import test_bpe, test_decontamination, test_language_id, test_near_duplicates, test_personal_data

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MARKS = ["[email]", "[ip]", "[card]", "[phone]", "[term]", ""]


def spliced(text, spans):
    made, upto = [], 0
    for start, kind, end in spans:
        if start >= upto:
            made.append(text[upto:start] + MARKS[kind])
        upto = max(upto, end)
    return "".join(made) + text[upto:]


def plain(rows, items, profiles):
    """The whole pipeline over (doc_id, text) rows, without Spark."""
    rows = [r for r in rows if (p := test_language_id.brute_force(r[1], profiles, 300)) and p[0] != "und" and p[1] > 0]
    kept = {k for k, _, _, keep in test_near_duplicates.brute_force(rows, 5, 80) if keep}
    rows = list(dict.fromkeys(r for r in rows if r[0] in kept or r[0] is None))
    words = test_decontamination.words_of
    near = [
        (n, t) for n, (_, t) in enumerate(rows)
        if any(len(set(words(i)) - set(words(t))) <= 0.15 * len(words(i)) for _, i in items)
    ]
    found = {n for n, _ in test_decontamination.brute_force(near, items, 0.15)}
    rows = [r for n, r in enumerate(rows) if n not in found]
    spans = test_personal_data.with_terms(rows, 3, 0.7, 0.9)
    made = []
    for key, text in rows:
        text = spliced(text, spans[key, text])
        ids = test_bpe.LIBRARY.encode_ordinary(text)
        made.append((key, len(ids), ids, text))
    return sorted(made, key=str)


def result(spark, folder):
    return sorted(((r.doc_id, r.n_tokens, r.ids, r.text) for r in corpus_pipeline.run(spark, folder).collect()), key=str)


def test_the_stages_are_as_agreed():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_against_the_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = result(spark, folder)
    assert got == plain(rows, items, learn_profiles(docs))
    assert 0 < len(got) < len(rows)


def test_every_stage_on_odd_rows(spark, documents, tiny):
    text = "The mail of the one is a.b@c.de and the rest of the text is for the reader to read"
    item = "an item of the benchmark that must not be in the text of the corpus"
    rows = [(1, None), (2, ""), (3, "123 ..."), (4, text), (4, text), (5, text), (None, "null ids are kept in the corpus"), (6, f"so {item} ok"),
            (7, "the words " * 5000), (8, "a"), (9, "call +1 555 123 4567 for the thing of it")]
    docs = documents(rows).withColumn("spans", F.lit(1)).withColumn("__spans", F.lit("clash"))
    folder = tiny(documents=docs, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
    got = {r.doc_id: r.text for r in now.collect()}
    assert set(got) == {4, None, 7, 8, 9}
    assert got[4] == text.replace("a.b@c.de", "[email]") and got[9] == "call [phone] for the thing of it"
    assert now.count() == 5
    assert len(result(spark, folder)) == 5


def test_only_the_last_stage_leaves_a_folder(spark, documents, tiny):
    text = "The mail of the one is a.b@c.de and the rest of the text is for the reader to read"
    docs = documents([(k, f"{text} {k % 3}") for k in range(12)])
    folder = tiny(documents=docs, benchmark=spark.createDataFrame([(1, "an item that is not there")], "item_id long, text string"))
    place = Path(shared_folder(spark).removeprefix("file:")) / "starward"
    before = set(place.iterdir()) if place.exists() else set()
    assert len(result(spark, folder)) == 1
    (left,) = set(place.iterdir()) - before
    assert [p.name for p in left.iterdir()] == ["4"]


def test_decisions_by_row_move_no_texts(spark, documents, conf):
    """Language id and decontamination have no exchange above the scan of the documents."""
    conf("spark.sql.adaptive.enabled", "false")
    docs = documents([(1, "the text of one")])
    items = spark.createDataFrame([(1, "an item that is not there")], "item_id long, text string")
    for kept in (keep_identified(docs, {"en": ["a", "b"]}), keep_uncontaminated(docs, items)):
        above = kept._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
        assert len(above) == 2 and "Exchange" not in above[0]
        assert kept.schema == docs.schema


def test_empty_tables(spark, documents, tiny):
    folder = tiny(documents=documents([]), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert result(spark, folder) == []
