"""A corpus made ready for training: five stages, each written as Parquet and read by the next.

1. Language identification: documents of no known language go.
2. MinHash near-duplicates (five words, 80 %): one document of each group stays, the smallest id.
3. Benchmark decontamination: documents that hold a benchmark item go.
4. Personal data: spans are replaced by their kind, disclosing terms generalised or removed.
5. Byte-level BPE: every text is encoded and decoded again.

A stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of documents, whatever they are; the last adds what it made. A null id is an id
of its own kind: stages 2 and 3 keep such rows by their own texts, never by their id.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starward.llm.bpe import bpe_decode, bpe_encode
from starward.llm.decontamination import keep_uncontaminated
from starward.llm.language_id import keep_identified, learn_profiles
from starward.llm.near_duplicates import near_duplicates
from starward.llm.personal_data import personal_data, sanitised
from starward.operators.joins import BROADCAST_BYTES
from starward.sources.shared import delete_folder, shared_folder, temporary_tables, write_shared

RANKS = "byte_bpe_multi_50k.tiktoken"


def _split(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` without and with an id of ``ids``, which is written, so it is read twice.

    Few ids go to the rows: broadcast up to ``BROADCAST_BYTES``, after measuring; else both sides
    are shuffled. A null id is an id.
    """
    ids = write_shared(ids.select(F.col("doc_id").alias("id")), "ids")
    small = ids.count() * 8 <= BROADCAST_BYTES
    same = docs["doc_id"].eqNullSafe(ids["id"])
    named = F.broadcast(ids) if small else ids
    return docs.join(named, same, "left_anti"), docs.join(named, same, "left_semi")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without text, without a letter or with no n-gram of any profile.

    Decided row by row: repeated rows and null ids stay or go by their own texts. Texts are read
    whole, however long. An empty table, or one without labelled texts, keeps nothing.
    """
    return keep_identified(docs, learn_profiles(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; of equal rows, one.

    Rows that share an id with different texts are one document and stay or go together; rows
    without an id stay, of those with equal texts one. Null and empty texts are near nothing. Texts
    are read whole, however long. Only ids move, and the rows of ids that occur more than once. An
    empty table gives an empty result.
    """
    found = near_duplicates(docs)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    kept, _ = _split(docs, gone)
    repeated = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    once, several = _split(kept, repeated)
    free = "_".join(["hash", *docs.columns])  # a name no column has
    several = several.withColumn(free, F.xxhash64("text")).dropDuplicates(["doc_id", free]).drop(free)
    return once.union(several)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark``, decided row by row.

    Null and empty texts stay, and all rows if there are no items. Texts are read whole, however
    long. An empty table gives an empty result.
    """
    return keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts their kind in the place of personal data; all rows stay.

    Null texts stay null. A row is changed by its own text, whatever its id. An empty table gives
    an empty result.
    """
    return sanitised(docs, personal_data(docs))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): the ids of each text and the text decoded from them.

    One row per row; a null text has no ids and an empty text. Texts are read whole, however long.
    An empty table gives an empty result.
    """
    ranks = public_tokenizers.path(RANKS)
    decoded = bpe_decode(bpe_encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("data").cast("string").alias("text")
    )


STAGES = [
    ("language id", keep_known_languages),
    ("near duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal data", remove_personal_data),
    ("byte-level BPE", encode_and_decode),
]

#: Walks, sketches and merges have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again.

    What a stage writes on the way goes when its result is stored, and a result when the next one is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/starward/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if number:
            delete_folder(spark, f"{folder}/{number - 1}")
        docs = spark.read.parquet(path)
    return docs
