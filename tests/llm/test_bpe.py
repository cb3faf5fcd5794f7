from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starward.llm import bpe
from starward.llm.bpe import bpe_decode, bpe_encode, merge_long, merge_word, ranks_of

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = ranks_of(PATH)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
TEXT = st.text(st.sampled_from(list("abthe 's1é中😀!") + list("\n\t\x0b\x1c\x85\xa0　\0")), max_size=40)


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=80))
def test_both_merges_agree_with_the_library(word):
    want = LIBRARY._encode_single_piece(word)
    assert merge_word(word, RANKS) == want
    assert merge_long(word, RANKS) == want or word in RANKS


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_the_pattern_splits_as_the_library_does(text):
    words = bpe.regex.findall(public_tokenizers.PATTERN, text)
    assert "".join(words) == text
    assert [i for word in words for i in merge_word(word.encode(), RANKS)] == LIBRARY.encode_ordinary(text)


def test_rows(documents, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 100)
    texts = [None, "", "  ", "<|endoftext|>", "word " * 300, "xyz" * 4000, "é中😀\n\n it's", "word word"]
    rows = [*enumerate(texts), (3, texts[3]), (None, "a b"), *((100 + k, "word the") for k in range(50))]
    frame = documents(rows).withColumn("ids", F.lit("clash"))
    got = sorted(map(tuple, bpe_decode(bpe_encode(frame, PATH, public_tokenizers.PATTERN), PATH).collect()), key=str)
    want = [(k, LIBRARY.encode_ordinary(t or ""), bytearray((t or "").encode())) for k, t in rows]
    assert got == sorted(want, key=str)


def test_empty_table(documents):
    assert bpe_encode(documents([]), PATH, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    from starward.llm.queries import QUERIES

    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = QUERIES["op9_byte_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = LIBRARY.encode_ordinary(texts[row.doc_id] or "")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), digest(ids))
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()
