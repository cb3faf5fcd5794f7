"""Exact repeats across documents, found from fixed-block anchors and removed.

A window is ``window`` consecutive words. A word goes if a window that covers it also starts in a
document with a smaller id. Every window of ``window`` words holds a whole block of
``(window + 1) // 2`` words that starts at a multiple of the block size in its document. So:

1. Documents are packed into chunks, written once to the shared folder.
2. Every rolling block-sized window of a chunk goes out as a 32-bit remainder, dealt to buckets by
   the rest of its hash, once per chunk, with two bits: comes again in this chunk; is a block.
   The blocks are the index, the rolling windows the probes. A bucket answers which hashes are a
   block somewhere and occur more than once.
3. Hits are extended: the windows around a hit go out with 64 bits of their own hash and the
   smallest id in the chunk, and come back if a smaller id is found elsewhere. Their buckets come
   from an independent hash, so that at least 64 and log2(buckets) bits must agree.
4. Marked windows that touch or overlap grow together to maximal repeats and are cut.

Nothing is sent per pair of documents; a passage in a third of all documents travels once per
chunk. The number of buckets follows the number of words, so the share of false hits stays the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starward.llm.packing import (
    buckets_for,
    chunk_number,
    pack,
    pack_sorted,
    pack_strings,
    together,
    unpack,
    unpack_sorted,
    unpack_strings,
)
from starward.llm.word_hashes import Words
from starward.sources.shared import write_shared

#: Characters of text in a chunk, and words in a bucket.
CHUNK_CHARS, BUCKET_WORDS = 4 << 20, 3_000_000
LAST = np.iinfo(np.int64).max
LOW = np.uint64(32)


def pack_chunks(chars: int) -> Callable:
    """Arrow batches of (key, text) to chunks: keys (null: last), texts and words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size, made = [], [], 0, 0

        def flush():
            columns = [
                pa.array([chunk_number(made)], pa.int64()),
                pa.array([pack(np.array(keys, np.int64))], pa.binary()),
                pa.array([pack_strings(texts)], pa.binary()),
                pa.array([sum(len(text.split()) for text in texts)], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "keys", "texts", "n_words"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(LAST if key is None else key)
                texts.append((text.as_py() or "").encode())
                size += len(texts[-1])
                if size >= chars:
                    yield flush()
                    keys, texts, size, made = [], [], 0, made + 1
        if keys:
            yield flush()

    return build


class Chunk:
    """The words of a chunk, its documents in the order of their keys."""

    def __init__(self, keys: bytes, texts: bytes):
        keys = unpack(keys, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, stored = keys[order], unpack_strings(texts)
        self.texts = [stored[k] for k in order]
        self.words = Words(self.texts)

    def bucketed(self, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows; bucket (high 32 bits) and 32-bit remainder of each."""
        at = self.words.windows(size)
        rolled = self.words.rolling(size)[at]
        return at, (((rolled >> LOW) % np.uint64(buckets)) << LOW) | (rolled & np.uint64(0xFFFFFFFF))

    def long_windows(self, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = self.words.windows(size)
        where = self.words.rolling(size, 1)[at] % np.uint64(buckets)
        return at, where.astype(np.int64), self.words.rolling(size)[at]


def runs(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ``values``."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def stretches(values: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each run of equal values in sorted ``values``."""
    cuts = [*runs(values).tolist(), len(values)]
    return list(zip(cuts, cuts[1:], strict=False))


def inside(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def batch(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, schema.values(), strict=True)], names=list(schema)
    )


def _probe(block: int, buckets: int) -> Callable:
    schema = {"bucket": pa.int64(), "chunk": pa.int64(), "hashes": pa.binary(), "flags": pa.binary()}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunks in batches:
            for number, keys, texts in zip(*(chunks.column(k) for k in range(3)), strict=True):
                chunk = Chunk(keys.as_py(), texts.as_py())
                at, hashes = chunk.bucketed(block, buckets)
                offset = at - chunk.words.starts[chunk.words.texts_of(at)]
                anchors = np.sort(hashes[offset % block == 0])
                hashes.sort()
                first = runs(hashes)
                again = np.diff(first, append=len(hashes)) > 1
                hashes = hashes[first]
                flags = again.astype(np.uint8) + 2 * inside(hashes, anchors).astype(np.uint8)
                where = (hashes >> LOW).astype(np.int64)
                yield batch(
                    schema,
                    [
                        (int(where[a]), number.as_py(), pack_sorted(hashes[a:b].astype(np.uint32)), pack(flags[a:b]))
                        for a, b in stretches(where)
                    ],
                )

    return probe


def _match(messages: pa.Table) -> pa.Table:
    """Per chunk the hashes of one bucket that are a block somewhere and occur more than once."""
    sent = [unpack_sorted(x.as_py(), np.uint32) for x in messages["hashes"]]
    flags = np.concatenate([unpack(x.as_py(), np.uint8) for x in messages["flags"]])
    hashes = np.concatenate(sent)
    order = np.argsort(hashes, kind="stable")
    first = runs(hashes[order])
    either = np.bitwise_or.reduceat(flags[order], first)
    often = (either & 1).astype(bool) | (np.diff(first, append=len(hashes)) > 1)
    hits = hashes[order][first][often & (either >= 2)]
    rows = [
        (chunk, bucket, pack_sorted(found))
        for chunk, bucket, own in zip(messages["chunk"].to_pylist(), messages["bucket"].to_pylist(), sent, strict=True)
        if len(found := own[inside(own, hits)])
    ]
    return pa.Table.from_batches(
        [batch({"chunk": pa.int64(), "bucket": pa.int64(), "hashes": pa.binary()}, rows)]
    )


def _own(rows: pa.Table) -> tuple[dict, list[dict]]:
    """The row of the chunk itself, and the answers to it."""
    every = rows.to_pylist()
    return next(row for row in every if row["texts"] is not None), [row for row in every if row["texts"] is None]


def _extend(window: int, block: int, buckets: int) -> Callable:
    """The windows around hits, with the smallest key in the chunk."""
    schema = {"bucket": pa.int64(), "chunk": pa.int64(), "hashes": pa.binary(), "owners": pa.binary()}

    def extend(rows: pa.Table) -> pa.Table:
        own, answers = _own(rows)
        if not answers:
            return pa.Table.from_batches([batch(schema, [])])
        chunk = Chunk(own["keys"], own["texts"])
        at, hashes = chunk.bucketed(block, buckets)
        hits = np.sort(
            np.concatenate(
                [
                    (np.uint64(a["bucket"]) << LOW) | unpack_sorted(a["hashes"], np.uint32).astype(np.uint64)
                    for a in answers
                ]
            )
        )
        upto = np.zeros(len(chunk.words.places) + 1, np.int64)
        upto[at[inside(hashes, hits)] + 1] = 1
        np.cumsum(upto, out=upto)
        at, where, hashes = chunk.long_windows(window, buckets)
        near = upto[at + window - block + 1] > upto[at]
        at, where, hashes = at[near], where[near], hashes[near]
        order = np.lexsort((at, hashes, where))  # documents are in the order of their keys
        at, where, hashes = at[order], where[order], hashes[order]
        first = np.union1d(runs(where), runs(hashes))
        where, hashes = where[first], hashes[first]
        owners = chunk.keys[chunk.words.texts_of(at[first])]
        return pa.Table.from_batches(
            [
                batch(
                    schema,
                    [
                        (int(where[a]), own["chunk"], pack_sorted(hashes[a:b]), pack(owners[a:b]))
                        for a, b in stretches(where)
                    ],
                )
            ]
        )

    return extend


def _first_owner(messages: pa.Table) -> pa.Table:
    """Per chunk the hashes of one bucket that some other chunk has under a smaller key."""
    sent = [unpack_sorted(x.as_py(), np.uint64) for x in messages["hashes"]]
    owned = [unpack(x.as_py(), np.int64) for x in messages["owners"]]
    hashes, owners = np.concatenate(sent), np.concatenate(owned)
    order = np.argsort(hashes, kind="stable")
    first = runs(hashes[order])
    smallest = np.minimum.reduceat(owners[order], first)
    known = hashes[order][first]
    rows = [
        (chunk, pack_sorted(found))
        for chunk, own, keys in zip(messages["chunk"].to_pylist(), sent, owned, strict=True)
        if len(found := own[smallest[np.searchsorted(known, own)] < keys])
    ]
    return pa.Table.from_batches([batch({"chunk": pa.int64(), "hashes": pa.binary()}, rows)])


SPAN = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
CUT = {"key": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "repeats": SPAN, "kept": pa.string()}


def _cut(window: int) -> Callable:
    """The documents of a chunk without the words of marked windows."""

    def cut(rows: pa.Table) -> pa.Table:
        own, answers = _own(rows)
        chunk = Chunk(own["keys"], own["texts"])
        words = chunk.words
        at, _, hashes = chunk.long_windows(window, 1)
        elsewhere = [unpack_sorted(a["hashes"], np.uint64) for a in answers]
        marked = inside(hashes, np.sort(np.concatenate(elsewhere))) if elsewhere else np.zeros(len(at), bool)
        order = np.argsort(hashes, kind="stable")  # the smallest key comes first among equals
        keys = chunk.keys[words.texts_of(at)]
        first = runs(hashes[order])
        smallest = np.repeat(keys[order][first], np.diff(first, append=len(order)))
        marked[order] |= keys[order] > smallest
        change = np.zeros(len(words.places) + 1, np.int64)
        change[at[marked]] += 1
        change[at[marked] + window] -= 1
        gone = np.cumsum(change[:-1]) > 0
        made = []
        for key, text, start, size in zip(
            chunk.keys.tolist(), chunk.texts, words.starts.tolist(), words.sizes.tolist(), strict=True
        ):
            mask = gone[start : start + size]
            edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            kept = compress(text.split(), ~mask) if len(edges) else text.split()
            made.append(
                (
                    None if key == LAST else key,
                    size,
                    int(mask.sum()),
                    [{"first": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()],
                    b" ".join(kept).decode(),
                )
            )
        return pa.Table.from_batches([batch(CUT, made)])

    return cut


def cut_repeats(
    documents: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``documents``: key, n_words, n_removed, repeats, kept.

    ``repeats`` are the removed spans, [first, end) in words of the input; ``kept`` the kept words
    joined by one blank. Keys are integers. Null or empty texts have no words; texts shorter than
    a window lose none. Rows that repeat a key do not lose words to each other, as neither key is
    smaller; a null key counts as larger than any other. Other columns are not read, whatever
    their names. An empty table gives an empty result.
    """
    spark, block = documents.sparkSession, (window + 1) // 2
    chunks = write_shared(
        documents.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(
            pack_chunks(CHUNK_CHARS), "chunk long, keys binary, texts binary, n_words long"
        ),
        "repeat-chunks",
    )
    buckets = buckets_for(spark, chunks.agg(F.sum("n_words")).first()[0], BUCKET_WORDS)
    packed = chunks.select("chunk", "keys", "texts")
    hits = (
        packed.mapInArrow(_probe(block, buckets), "bucket long, chunk long, hashes binary, flags binary")
        .groupBy("bucket")
        .applyInArrow(_match, "chunk long, bucket long, hashes binary")
    )
    elsewhere = (
        together([packed, hits])
        .groupBy("chunk")
        .applyInArrow(
            _extend(window, block, buckets), "bucket long, chunk long, hashes binary, owners binary"
        )
        .groupBy("bucket")
        .applyInArrow(_first_owner, "chunk long, hashes binary")
    )
    return (
        together([packed, elsewhere])
        .groupBy("chunk")
        .applyInArrow(
            _cut(window),
            "key long, n_words long, n_removed long, "
            "repeats array<struct<first: bigint, end: bigint>>, kept string",
        )
        .withColumnRenamed("key", key)
    )
