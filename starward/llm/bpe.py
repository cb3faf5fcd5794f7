"""Byte-level BPE over a corpus: every distinct word is encoded once, whatever its count.

Encoding: the texts of a chunk of documents are split into pre-tokens; a chunk keeps its distinct
words and, in the order of the text, the positions as numbers of words. Its distinct words go out
by hash, so that all copies of a word meet in one bucket, where the word is merged once. The ids
come back to the chunk, which puts them in the places of its words. A frequent word travels once
per chunk, not once per occurrence. The texts are split twice, once for the words and once for
the positions, which costs less than carrying the positions along. A chunk is numbered by its
task, so it is the same both times, and after the loss of an executor, if the scan of the input
is repeatable, as that of files is; a mark of its words makes sure of it.

Decoding looks ids up in the token-byte table, whose size is the size of the vocabulary, in every
task: a map-side join, no shuffle.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

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
from starward.llm.word_hashes import Numbers

#: Characters of text in a chunk, and of text whose distinct words are in one bucket.
CHUNK_CHARS, BUCKET_CHARS = 8 << 20, 64 << 20
#: Words up to this many bytes are merged by scanning, longer ones with a heap.
SHORT = 32


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the leftmost pair of lowest rank is joined until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT:
        return merge_long(word, ranks)
    get, none = ranks.get, len(ranks) << 32
    edges = list(range(len(word) + 1))
    pairs = [get(word[k : k + 2], none) for k in range(len(word) - 1)]
    while pairs and (best := min(pairs)) != none:
        at = pairs.index(best)
        del edges[at + 1], pairs[at]
        if at < len(pairs):
            pairs[at] = get(word[edges[at] : edges[at + 2]], none)
        if at:
            pairs[at - 1] = get(word[edges[at - 1] : edges[at + 1]], none)
    return [ranks[word[i:j]] for i, j in zip(edges, edges[1:], strict=False)]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n: a heap of pairs over a linked list of parts."""
    end = list(range(1, len(word) + 1))  # of the part that starts here
    before = list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and end[at] < len(word):
            stop = end[end[at]]
            if (rank := ranks.get(word[at:stop])) is not None:
                heapq.heappush(heap, (rank, at, stop))

    for at in range(len(word) - 1):
        offer(at)
    while heap:
        _, at, stop = heapq.heappop(heap)
        middle = end[at]
        if middle <= at or middle >= len(word) or end[middle] != stop:
            continue  # one of the two parts has been joined since
        end[at], end[middle] = stop, -1
        if stop < len(word):
            before[stop] = at
        offer(before[at])
        offer(at)
    ids, at = [], 0
    while at < len(word):
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


def _deal(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets by the hash of the word, and the numbers of the words of each."""
    where = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(where, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
        if len(own):
            yield int(where[own[0]]), own


def _chunks(pattern: str, chars: int, send: Callable) -> Callable:
    """Arrow batches of (key, text) to what ``send`` makes of each chunk."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, made = regex.compile(pattern).findall, 0
        numbers, keys, sizes, places, size = Numbers(), [], [], [], 0

        def flush():
            words = [word.encode() for word in numbers]
            return send(chunk_number(made), words, keys, sizes, places)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = find(text)
                places.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                keys.append(key.as_py())
                sizes.append(len(found))
                size += len(text)
                if size >= chars:
                    yield flush()
                    made += 1
                    numbers, keys, sizes, places, size = Numbers(), [], [], [], 0
        if keys:
            yield flush()

    return build


def _positions(key_type: pa.DataType) -> Callable:
    """The chunk itself: its documents and the numbers of their words, in the order of the text."""

    def send(chunk, words, keys, sizes, places) -> pa.RecordBatch:
        mark = xxhash.xxh3_64_intdigest(b"\0".join(words)) >> 1
        made = [pack(np.array(sizes, np.uint32)), pack(np.concatenate(places))]
        columns = [pa.array([chunk]), pa.array([mark]), pa.array([keys], pa.list_(key_type))]
        columns += [pa.array([data], pa.binary()) for data in made]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "mark", "keys", "sizes", "places"])

    return send


def _words(buckets: int) -> Callable:
    """The distinct words of a chunk, one row per bucket."""

    def send(chunk, words, keys, sizes, places) -> pa.RecordBatch:
        mark = xxhash.xxh3_64_intdigest(b"\0".join(words)) >> 1
        rows = [
            (bucket, chunk, mark, pack_sorted(own.astype(np.uint32)), pack_strings([words[k] for k in own]))
            for bucket, own in _deal(words, buckets)
        ]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 2
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
            names=["bucket", "chunk", "mark", "numbers", "words"],
        )

    return send


def _encode(path: str) -> Callable:
    """All copies of the words of one bucket: each distinct word is merged once."""

    def encode(rows: pa.Table) -> pa.Table:
        ranks, known, counts, flat = ranks_of(path), {}, [], []
        for packed in rows["words"]:
            words = unpack_strings(packed.as_py())
            for word in words:
                if word not in known:
                    known[word] = merge_word(word, ranks)
            ids = [known[word] for word in words]
            counts.append(pack(np.fromiter(map(len, ids), np.uint32, len(ids))))
            flat.append(pack(np.fromiter(chain.from_iterable(ids), np.uint32)))
        kept = rows.select(["chunk", "mark", "numbers"])
        return kept.append_column("counts", pa.array(counts, pa.binary())).append_column(
            "ids", pa.array(flat, pa.binary())
        )

    return encode


def _reassemble(key_type: pa.DataType) -> Callable:
    """The ids of every document of one chunk, in the order of its text."""

    def reassemble(rows: pa.Table) -> pa.Table:
        if len(rows["mark"].unique()) > 1:
            raise ValueError("a chunk was read twice with different rows: write the input first")
        own = next(row for row in rows.to_pylist() if row["places"] is not None)
        numbers, counts, ids = [], [], []
        for number, count, flat in zip(rows["numbers"], rows["counts"], rows["ids"], strict=True):
            if number.is_valid:
                numbers.append(unpack_sorted(number.as_py(), np.uint32))
                counts.append(unpack(count.as_py(), np.uint32))
                ids.append(unpack(flat.as_py(), np.uint32))
        places = unpack(own["places"], np.uint32)
        ends = np.cumsum(unpack(own["sizes"], np.uint32), dtype=np.int64)
        made = np.zeros(0, np.int32)
        offsets = np.zeros(len(ends) + 1, np.int64)
        if len(places):
            number, count = np.concatenate(numbers), np.concatenate(counts).astype(np.int64)
            start = np.zeros(len(number), np.int32)
            size = np.zeros(len(number), np.int32)
            start[number], size[number] = np.cumsum(count) - count, count
            many = size[places]
            upto = np.cumsum(many, dtype=np.int64)
            here = np.repeat(start[places] - (upto - many).astype(np.int32), many)
            here += np.arange(len(here), dtype=np.int32)
            made = np.concatenate(ids)[here].astype(np.int32)
            offsets[1:] = np.concatenate([[0], upto])[ends]
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(made))
        return pa.table(
            [pa.array(own["keys"], key_type), lists.cast(pa.list_(pa.int32()))], names=["key", "ids"]
        )

    return reassemble


def bpe_encode(
    documents: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``documents``: key and ``ids`` (array of int).

    ``ranks`` is the path of a rank file on every executor, ``pattern`` what splits texts into
    words. A null or empty text has no ids. Repeated rows and null keys stay rows of their own;
    other columns are not read, whatever their names. An empty table gives an empty result.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()
    total = rows.agg(F.sum(F.length("text"))).first()[0]
    buckets = buckets_for(documents.sparkSession, total, BUCKET_CHARS)
    chunks = rows.mapInArrow(
        _chunks(pattern, CHUNK_CHARS, _positions(arrow)),
        f"chunk long, mark long, keys array<{name}>, sizes binary, places binary",
    )
    encoded = (
        rows.mapInArrow(
            _chunks(pattern, CHUNK_CHARS, _words(buckets)),
            "bucket long, chunk long, mark long, numbers binary, words binary",
        )
        .groupBy("bucket")
        .applyInArrow(_encode(ranks), "chunk long, mark long, numbers binary, counts binary, ids binary")
    )
    return (
        together([chunks, encoded])
        .groupBy("chunk")
        .applyInArrow(_reassemble(arrow), f"key {name}, ids array<int>")
        .withColumnRenamed("key", key)
    )


def bpe_decode(encoded: DataFrame, ranks: str, ids: str = "ids", to: str = "data") -> DataFrame:
    """``encoded`` with the bytes of its ids as binary column ``to`` (null ids: null)."""

    @F.arrow_udf("binary")
    def decode(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of_rank = {rank: token for token, rank in ranks_of(ranks).items()}
        token = [of_rank.get(rank) for rank in range(max(of_rank, default=-1) + 1)].__getitem__
        for lists in column:
            flat, edges = lists.values.to_numpy(), lists.offsets.to_pylist()
            whole = [
                b"".join(map(token, flat[a:b].tolist())) for a, b in zip(edges, edges[1:], strict=False)
            ]
            yield pa.array(whole, pa.binary(), mask=lists.is_null().to_numpy(zero_copy_only=False))

    return encoded.withColumn(to, decode(F.col(ids)))
