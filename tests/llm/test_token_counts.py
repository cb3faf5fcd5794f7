from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starward.llm.token_counts import PieceCounter, segments, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXT = st.text(st.sampled_from(list("ab'st1é中😀!<|>") + list(" \n\t\r\x0b\x1c\x85\xa0 　\0")), max_size=30)


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_pieces_add_up_to_the_library(texts):
    assert PieceCounter(PATH).count(texts) == [expected(text) for text in texts]


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 10))
def test_segments_are_cut_safely(text, size):
    parts = list(segments(text, size))
    assert "".join(part for part, _ in parts) == text
    assert [n for _, n in parts] == [len(part.encode()) for part, _ in parts]
    assert sum(expected(part) for part, _ in parts) == expected(text)


def test_segments_follow_bytes_in_any_script():
    for word in ("word ", "слово ", "中文字 ", "😀 "):
        sizes = [n for _, n in segments(word * 5000, 4096)]
        assert len(sizes) > 4 and all(4096 <= n < 4096 + len(word.encode()) for n in sizes[:-1])


def test_rows(spark, documents):
    texts = [None, "", " ", "<|endoftext|> a<|endoftext|>", "word " * 3000, "x" * 5000, "it's  \n ok"]
    rows = [*enumerate(texts), (3, texts[3]), (None, "a b")]
    frame = documents(rows).withColumn("n_tokens", F.lit("clash"))
    got = sorted(map(tuple, token_counts(frame, PATH).collect()), key=str)
    want = [(k, len((t or "").encode()), expected(t), expected(t) > 1024) for k, t in rows]
    assert got == sorted(want, key=str)


def test_empty_table(documents):
    assert token_counts(documents([]), PATH).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    from starward.llm.queries import QUERIES

    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = QUERIES["op4_token_counts"](spark, folder).collect()
    assert {row.doc_id: row.n_tokens for row in got} == {k: expected(t) for k, t in texts.items()}
