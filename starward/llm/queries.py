"""The operators of this subpackage over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starward.llm.bpe import bpe_decode, bpe_encode
from starward.llm.decontamination import contaminated
from starward.llm.embeddings import embedding_duplicates
from starward.llm.fingerprints import edited_likeness
from starward.llm.language_id import held_out, identify, learn_profiles
from starward.llm.licenses import license_matches, license_texts, notices
from starward.llm.near_duplicates import near_duplicates
from starward.llm.oracle import ORACLE
from starward.llm.personal_data import KINDS, personal_data, span_list
from starward.llm.phrases import collocations
from starward.llm.repeats import cut_repeats
from starward.llm.spelling import spelling_variants
from starward.llm.token_counts import token_counts
from starward.llm.warc import audit, fixity, merkle_tree, warc_records
from starward.sources.shared import write_result


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    documents = table(spark, folder, "documents")
    out = held_out(F.col("doc_id"))
    profiles = learn_profiles(documents.where(F.col("doc_id").isNotNull() & ~out))
    return identify(documents, profiles).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices and whole license texts in documents."""
    templates = notices(spark).union(license_texts(spark))
    return write_result(spark, lambda: license_matches(table(spark, folder, "documents"), templates), "licenses")


def op3_embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of vectors with a cosine of 0.9 or more."""
    vectors = table(spark, folder, "embeddings")
    return write_result(spark, lambda: embedding_duplicates(vectors, threshold=0.9), "embeddings")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(table(spark, folder, "documents"), tokenizer)


def op5_warc_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What an audit finds in a damaged copy of the archive of all pages.

    In the copy, a byte in the middle of the record differs where the page's id is divisible by
    101, and records whose id leaves 7 when divided by 211 are lost.
    """

    def build() -> DataFrame:
        records = warc_records(table(spark, folder, "pages"))
        middle = F.floor(F.length("record") / 2).cast("int")
        flipped = F.when(F.substring("record", middle, F.lit(1)) == b"#", F.lit(b"-")).otherwise(F.lit(b"#"))
        damaged = F.overlay("record", flipped, middle, F.lit(1))
        kept = F.coalesce(F.col("page_id") % 211 != 7, F.lit(True))
        copy = records.where(kept).withColumn(
            "record", F.when(F.col("page_id") % 101 == 0, damaged).otherwise(F.col("record"))
        )
        found = audit(merkle_tree(fixity(records)), merkle_tree(fixity(copy)))
        named = found.join(records.select("page_id", "archive", "place"), ["archive", "place"])
        return named.select("page_id", "status", "length", "found_length")

    return write_result(spark, build, "audit")


def op6_contaminated(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the place."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_cut_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the 13-word windows that a smaller document has as well."""

    def build() -> DataFrame:
        cut = cut_repeats(table(spark, folder, "documents"), window=13)
        return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

    return write_result(spark, build, "repeats")


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents that share 85 % of their 3-word shingles."""
    documents = table(spark, folder, "documents")
    return write_result(spark, lambda: near_duplicates(documents, words=3, percent=85), "duplicates")


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the bytes they stand for, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_encode(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe_decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data, and of the terms that disclose it."""

    def count(kind: str):
        own = F.filter("base", lambda s: s["kind"] == KINDS.index(kind))
        return F.size(own).cast("long").alias(f"n_{kind}")

    def build() -> DataFrame:
        found = personal_data(table(spark, folder, "documents"))
        counts = [count(kind) for kind in KINDS[:4]]
        digest = F.sha2(span_list(F.col("base")).cast("binary"), 256).alias("base_sha256")
        return found.select("doc_id", *counts, digest, span_list(F.col("spans")).alias("spans"))

    return write_result(spark, build, "personal")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the corpus with their near words, forms and roots."""
    return write_result(spark, lambda: spelling_variants(table(spark, folder, "documents")), "spelling")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The phrases of every language whose words belong together most."""
    return write_result(spark, lambda: collocations(table(spark, folder, "documents")), "collocations")


def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and how alike they are."""
    return write_result(spark, lambda: edited_likeness(table(spark, folder, "documents")), "fingerprints")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_embedding_duplicates": op3_embedding_duplicates,
    "op4_token_counts": op4_token_counts,
    "op5_warc_audit": op5_warc_audit,
    "op6_contaminated": op6_contaminated,
    "op7_cut_repeats": op7_cut_repeats,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_personal_data": op10_personal_data,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_collocations": op12_collocations,
    "op13_fingerprints": op13_fingerprints,
}

__all__ = ["ORACLE", "QUERIES"]
