"""Collocations: phrases whose words stand together more often than their parts would suggest.

Texts are packed into chunks of word numbers once. Frequent words get ids by rank of frequency over
the whole corpus, and each occurrence is rewritten to its id. Then, level by level:

1. Two neighbours are a pair of ids. The plane of all pairs is cut into tiles of ``SIDE`` by
   ``SIDE``. As ids are ranks, most occurrences fall on the few tiles near the origin: a tile with
   enough of them is counted by direct address, with a dense ``bincount``; the rest of the plane is
   dealt to strips and kept as sorted coordinates with counts. Longer phrases are all in strips.
2. Tables of chunks are added up in a tree of at most ``MERGED`` at a time, so that the tile of the
   most frequent words is no large group however many chunks there are.
3. A bit set of the phrases that reach the minimum goes to the tasks. A phrase is as rare as its rarest
   part, so only places where a frequent phrase starts, and another one a word later, are counted for
   the next level. What the bit set, of fixed size, lets through in error is counted in vain and dropped
   with all else below the minimum: counts are of whole phrases, word by word.

The ids of the most frequent words, a bounded number, go to all tasks, since nearly every chunk has them.
Those of the others come back to the chunks by a join on what each chunk holds once, so no key is hot. That
is the only time that places move; phrases are marked where the chunk is. Counts of all frequent
phrases, their scores and the rule against parts of longer phrases are joins and aggregations of
tables without places.

No stage calls Python twice: each call takes a worker, which stays beside the executor's heap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starward.llm.packing import chunk_number, lean, lean_group, pack, pack_sorted, together, unpack, unpack_sorted
from starward.llm.word_hashes import Numbers, mix
from starward.operators.ordering import global_row_number
from starward.sources.shared import write_shared

#: Fewest occurrences of a phrase, most words in it, phrases reported per language.
LEAST, LONGEST, REPORTED = 100, 5, 2000
#: Bytes of words a task holds before it hands over places, ids on the side of a tile, tables added up at once and strips of one table.
CHUNK_BYTES, SIDE, MERGED = 8 << 20, 1024, 256
#: Pairs of a chunk on a tile from which on direct address takes less than sorting.
DENSE = SIDE * SIDE // 64
#: Phrases in a strip of the whole table, and ids of last words that keep phrases of the same other words together.
STRIP_PAIRS, NEAR = 1 << 18, 1 << 12
NO_LANGUAGE = "und"
#: What ends a piece; tabs are blanks; A-Z in lower case.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
TABLE = bytes.maketrans(BREAKS + b"\t" + bytes(range(65, 91)), b"." * len(BREAKS) + b" " + bytes(range(97, 123)))
BREAK = -1
#: Distinct words, and times that places are handed over, after which chunks end.
CHUNK_WORDS, CHUNK_PARTS = 1 << 19, 8
#: Rows handed over at once.
ROWS = 1 << 16
#: Most frequent words whose ids go to all tasks, and bytes of the longest such word or language (16 MB in all, 2 MB if words are short).
HEAD, HEAD_BYTES = 1 << 17, 64
#: Bits of a sieve of frequent words or phrases (8 MB), and of what is sent of it at once.
SIEVE, SIEVE_BLOCK = 1 << 26, 1 << 16


def pieces(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Words in order, with ``b"."`` between pieces; texts much longer than ``size`` in parts."""
    text, begin = text.translate(TABLE), 0
    while begin < len(text):
        end = text.find(b".", begin + size)
        end = len(text) if end < 0 else end + 1
        yield text[begin:end].replace(b".", b" . ").split()
        begin = end


def _chunks(size: int) -> Callable:
    """Arrow batches of (lang, text) to chunks, each of one language: rows with places, then one with words and counts.

    Places are handed over at ``size`` bytes of words; the numbers of words go on, so that the frequent
    words of a language come once per chunk and not once per part of it.
    """
    names = ["chunk", "lang", "n_words", "words", "counts", "places"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        counts: dict[str, np.ndarray] = {}
        held = parts = made = 0

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def hand_over() -> Iterator[pa.RecordBatch]:
            for k, (lang, (numbers, places)) in enumerate(languages.items()):
                if places:
                    flat = np.concatenate(places)
                    places.clear()
                    own = np.bincount(flat[flat >= 0], minlength=len(numbers) - 1)
                    own[: len(counts[lang])] += counts[lang]
                    counts[lang] = own
                    yield rows([(chunk_number(made + k), lang, None, None, None, pack(flat))])

        def end() -> Iterator[pa.RecordBatch]:
            for k, (lang, (numbers, _)) in enumerate(languages.items()):
                words = [word.decode() for word in numbers][1:]
                yield rows([(chunk_number(made + k), lang, int(counts[lang].sum()), words, pack(counts[lang]), None)])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for found in pieces((text.as_py() or "").encode(), size):
                    if lang not in languages:
                        languages[lang], counts[lang] = (Numbers({b".": 0}), []), np.zeros(0, np.int64)
                    numbers, places = languages[lang]
                    own = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                    places += [own - 1, np.array([BREAK], np.int32)]
                    held += sum(map(len, found))
                    if held >= size:
                        yield from hand_over()
                        held, parts = 0, parts + 1
                        if parts == CHUNK_PARTS or sum(len(n) for n, _ in languages.values()) >= CHUNK_WORDS:
                            yield from end()
                            made, parts = made + len(languages), 0
                            languages.clear()
                            counts.clear()
        yield from hand_over()
        yield from end()

    return build


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: a row may hold megabytes."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def handed(names: list[str], columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for k in range(0, whole.num_rows, ROWS):
        yield whole.slice(k, ROWS)


def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, str, pa.Array]]:
    """Rows one by one, each with its language and its words, which stay in Arrow."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1), batch["lang"][k].as_py(), batch["words"][k].values


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct word of a chunk."""
    for row, lang, words in word_lists(batches):
        counts = pa.array(unpack(row["counts"][0].as_py(), np.int64))
        yield from handed(["lang", "word", "n"], [pa.repeat(lang, len(words)), words, counts])


def word_hashes(languages: list[str], words: list[str]) -> np.ndarray:
    keys = zip(languages, words, strict=True)
    return np.fromiter((xxhash.xxh3_64_intdigest(f"{lang}\n{word}") for lang, word in keys), np.uint64, len(words))


def phrase_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """Of phrases given by a column of ids for every word."""
    found = columns[0].astype(np.uint64)
    for ids in columns[1:]:
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.uint64))
    return found


def _sieve_blocks(hashes: Callable) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(hashes(*batch.columns) % np.uint64(SIEVE)).astype(np.int64)
            block = bits // SIEVE_BLOCK
            for own in np.split(bits, np.flatnonzero(np.diff(block)) + 1) if len(bits) else ():
                marks = np.zeros(SIEVE_BLOCK, bool)
                marks[own % SIEVE_BLOCK] = True
                data = pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([own[0] // SIEVE_BLOCK]), data], names=["block", "marks"])

    return build


def _either(rows: pa.Table) -> pa.Table:
    every = [np.frombuffer(x.as_py(), np.uint8) for x in rows["marks"]]
    return pa.table({"block": rows["block"][:1], "marks": pa.array([np.bitwise_or.reduce(every).tobytes()], pa.binary())})


def sieve(known: DataFrame, hashes: Callable) -> Broadcast:
    """A bit set of the hashes of ``known`` for all tasks, ``SIEVE`` bits however many there are.

    What it lets through in error costs a row in the join or count behind it and changes nothing.
    """
    blocks = known.mapInArrow(_sieve_blocks(hashes), "block long, marks binary")
    blocks = blocks.groupBy("block").applyInArrow(_either, "block long, marks binary")
    whole = np.zeros((SIEVE // SIEVE_BLOCK, SIEVE_BLOCK // 8), np.uint8)
    for row in blocks.collect():  # bounded: SIEVE bits
        whole[row.block] = np.frombuffer(row.marks, np.uint8)
    return known.sparkSession.sparkContext.broadcast(whole.reshape(-1))


def passing(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    bits = (hashes % np.uint64(SIEVE)).astype(np.int64)
    return (marks[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


def head(known: DataFrame) -> tuple[Broadcast, DataFrame]:
    """The most frequent words by language with their ids, for all tasks, and the ``known`` words left."""
    inside = (F.col("id") < HEAD) & (F.octet_length("lang") <= HEAD_BYTES) & (F.octet_length("word") <= HEAD_BYTES)
    rows = known.where(inside).select("lang", "word", "id").toArrow().sort_by("lang")  # bounded: HEAD rows
    langs = rows["lang"].to_pylist()
    starts = [k for k in range(len(langs)) if not k or langs[k] != langs[k - 1]]
    spans = {langs[a]: (a, b) for a, b in pairwise([*starts, len(langs)])}
    ids = rows["id"].to_numpy().astype(np.int32)
    return known.sparkSession.sparkContext.broadcast((spans, rows["word"].combine_chunks(), ids)), known.where(~inside)


def head_ids(lang: str, words: pa.Array, most: Broadcast) -> np.ndarray:
    """The id of every word, ``BREAK`` if it is not among the most frequent."""
    spans, every, ids = most.value
    begin, end = spans.get(lang, (0, 0))
    at = pc.index_in(words, value_set=every[begin:end]).fill_null(-1).to_numpy()
    return np.append(ids[begin:end], np.int32(BREAK))[at]


def _head_rows(most: Broadcast) -> Callable:
    """The ids of a chunk's words in one row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, lang, words in word_lists(batches):
            ids = pa.array([pack(head_ids(lang, words, most))], pa.binary())
            yield pa.RecordBatch.from_arrays([row["chunk"], ids], names=["chunk", "ids"])

    return build


def _word_rows(most: Broadcast, marks: Broadcast) -> Callable:
    """The other words of a chunk that may be frequent, each with its number there."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, lang, words in word_lists(batches):
            local = np.flatnonzero(head_ids(lang, words, most) == BREAK)
            words = words.take(pa.array(local))
            may = passing(word_hashes([lang] * len(words), words.to_pylist()), marks.value)
            local, words = local[may], words.filter(pa.array(may))
            columns = [pa.repeat(row["chunk"][0], len(local)), pa.repeat(lang, len(local)), pa.array(local), words]
            yield from handed(["chunk", "lang", "local", "word"], columns)

    return build


def ranked(counts: DataFrame, names: list[str], label: str) -> DataFrame:
    """``counts`` (names, n) with an id from 0: the rank by frequency, ties by name."""
    numbered = global_row_number(counts.withColumn("_less", -F.col("n")), ["_less", *names], "id")
    return write_shared(numbered.drop("_less").withColumn("id", F.col("id") - 1), label)


STATE = "chunk long, words binary, phrases binary, places long"


def _state(chunk: int, words: np.ndarray, phrases: np.ndarray | None, length: int) -> pa.Table:
    """Ids of words; 0 where a phrase of ``length`` words that may be frequent starts, a word if there are none yet."""
    ready = len(places(words, words if phrases is None else phrases, length))
    made = [chunk, pack(words), b"" if phrases is None else pack(phrases), ready]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    return pa.table([pa.array([x], k) for x, k in zip(made, kinds, strict=True)], names=["chunk", "words", "phrases", "places"])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    words = unpack(row["words"], np.int64)
    return words, unpack(row["phrases"], np.int8) if row["phrases"] else words


def _first_state(rows: pa.Table) -> pa.Table:
    """The parts of a chunk with ids for numbers; rare words are breaks."""
    known = rows.filter(rows["local"].is_valid())
    most = rows.filter(rows["ids"].is_valid())["ids"][0].as_py()
    ids = np.append(unpack(most, np.int32), BREAK).astype(np.int64)  # the last cell is for breaks
    ids[known["local"].to_numpy()] = known["id"].to_numpy()
    made = []
    for part in rows.filter(rows["words"].is_valid())["words"]:
        made.append(_state(rows["chunk"][0].as_py(), ids[unpack(part.as_py(), np.int32)], None, 1))
    return pa.concat_tables(made)


def places(words: np.ndarray, phrases: np.ndarray, length: int) -> np.ndarray:
    """Where a phrase of ``length`` words starts, and another one a word later, that may be frequent.

    Only there may the phrase of one word more be frequent.
    """
    last = max(len(words) - length, 0)
    return np.flatnonzero((phrases[:last] >= 0) & (phrases[1 : last + 1] >= 0))


def longer(row: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words, phrases and places of a chunk, and the phrases of one word more there, a column per word."""
    words, phrases = _unpacked(row)
    at = places(words, phrases, length)
    return words, phrases, at, [words[at + k] for k in range(length + 1)]


def _sorted(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs by both ids (of ids below 2**31 by one number), and which are new in it."""
    if max(first.max(initial=0), second.max(initial=0)) < 1 << 31:
        order = np.argsort((first << 32) | second)
    else:
        order = np.lexsort((second, first))
    return order, (np.diff(first[order], prepend=-1) != 0) | (np.diff(second[order], prepend=-1) != 0)


def distinct(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct phrases and how often each occurs, or the sum of ``counts`` of each."""
    first = columns[0]
    for second in columns[1:-1]:  # the words so far become one number
        order, new = _sorted(first, second)
        first = np.empty(len(order), np.int64)
        first[order] = np.cumsum(new) - 1
    order, new = _sorted(first, columns[-1])
    start = np.flatnonzero(new)
    total = np.diff(start, append=len(order)) if counts is None else np.add.reduceat(counts[order], start)
    return [ids[order[start]] for ids in columns], total


def covered(words: np.ndarray, phrases: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words inside frequent phrases of ``size`` words; what stands between them is one break.

    All parts of a frequent phrase are frequent, so no longer one needs the other words.
    """
    start = np.flatnonzero(phrases >= 0)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + size, -1)
    inside = np.cumsum(change[:-1]) > 0
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    return np.where(inside, words, BREAK)[kept], phrases[kept]


def _next_state(length: int, marks: Broadcast) -> Callable:
    """The state of a chunk with phrases one word longer."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            words, phrases, at, columns = longer(row, length)
            phrases = np.full(len(words), BREAK, np.int8)
            phrases[at[passing(phrase_hashes(columns), marks.value)]] = 0
            yield from _state(row["chunk"], *covered(words, phrases, length + 1), length + 1).to_batches()

    return build


TILE = {"row": pa.int64(), "col": pa.int64(), "part": pa.int64(), "cells": pa.list_(pa.binary()), "counts": pa.binary()}
TILE_DDL = "row long, col long, part long, cells array<binary>, counts binary"


def tile_of(first: np.ndarray, second: np.ndarray, side: int) -> np.ndarray:
    return (first // side << 32) | (second // side)


def tiles(
    first: np.ndarray, second: np.ndarray, dense: np.ndarray, strips: int, side: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, column, cells, counts): the ``dense`` tiles by direct address, all else by strip.

    A cell of a tile is its address there; a strip has no column (-1), its cells are pairs.
    """
    tile = tile_of(first, second, side)
    at = np.searchsorted(dense, tile)
    direct = dense[np.minimum(at, len(dense) - 1)] == tile if len(dense) else np.zeros(len(tile), bool)
    order = np.flatnonzero(direct)[np.argsort(at[direct], kind="stable")]
    cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
    for own in np.split(order, cuts[1:]) if len(order) else ():
        counts = np.bincount(first[own] % side * side + second[own] % side, minlength=side * side)
        cells = np.flatnonzero(counts)
        yield int(tile[own[0]]) >> 32, int(tile[own[0]]) & 0xFFFFFFFF, cells, counts[cells]
    columns, counts = distinct([first[~direct], second[~direct]])
    yield from dealt(*columns, counts, strips)


def _tile_sizes(side: int, least: int) -> Callable:
    """Pairs of a chunk on tiles with ``least`` of them: few rows, however many tiles the plane has."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            *_, (first, second) = longer(row, 1)
            tile, size = np.unique(tile_of(first, second, side), return_counts=True)
            often = size >= least
            yield pa.RecordBatch.from_arrays([pa.array(tile[often]), pa.array(size[often])], names=["tile", "size"])

    return build


def dealt(*table: np.ndarray | int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Sorted phrases (a column per word, counts, strips) by strip. The strip in one of more strips says that in fewer.

    Phrases that differ in the last word alone share a strip if its ids are ``NEAR``, since neighbours in
    order take fewer bytes; a word that stands before very many is spread over strips.
    """
    *columns, counts, strips = table
    strip = (phrase_hashes([*columns[:-1], columns[-1] // NEAR]) % np.uint64(strips)).astype(np.int64)
    order = np.argsort(strip, kind="stable")
    cuts = np.flatnonzero(np.diff(strip[order], prepend=-1))
    for own in np.split(order, cuts[1:]):
        if len(own):
            yield int(strip[own[0]]), -1, np.stack([ids[own] for ids in columns]), counts[own]


def _table(part: int, made: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    rows = []
    for row, column, cells, counts in made:
        first, *rest = [cells] if column >= 0 else cells
        rows.append((row, column, part, [pack_sorted(first), *map(pack, rest)], pack(counts)))
    columns = zip(*rows, strict=True) if rows else [[]] * len(TILE)
    return pa.table([pa.array(c, k) for c, k in zip(columns, TILE.values(), strict=True)], names=list(TILE))


def _count(length: int, dense: np.ndarray, strips: int, side: int) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each(batches):
            *_, columns = longer(row, length)
            if length == 1:
                made = tiles(*columns, dense, strips, side)
            else:
                columns, counts = distinct(columns)
                made = dealt(*columns, counts, strips)
            yield from _table(row["part"], made).to_batches()

    return build


def summed(rows: pa.Table, side: int) -> tuple[int, list[np.ndarray], np.ndarray]:
    """The sum of some tables of one tile or strip: column, phrases (a column of ids per word) and counts."""
    row, column = rows["row"][0].as_py(), rows["col"][0].as_py()
    if column >= 0:
        total = np.zeros(side * side, np.int64)
        for cells, counts in zip(rows["cells"], rows["counts"], strict=True):
            total[unpack_sorted(cells[0].as_py(), np.int64)] += unpack(counts.as_py(), np.int64)
        cells = np.flatnonzero(total)
        return column, [cells // side + row * side, cells % side + column * side], total[cells]
    parts = [[unpack_sorted(first, np.int64), *(unpack(ids, np.int64) for ids in rest)] for first, *rest in rows["cells"].to_pylist()]
    counts = np.concatenate([unpack(x.as_py(), np.int64) for x in rows["counts"]])
    return column, *distinct([np.concatenate(ids) for ids in zip(*parts, strict=True)], counts)


def _add(strips: int, merged: int, side: int) -> Callable:
    """Up to ``merged`` parts become one; a strip is dealt to ``strips`` of the next round."""

    def add(rows: pa.Table) -> pa.Table:
        column, ids, counts = summed(rows, side)
        part = rows["part"][0].as_py() // merged
        if column < 0:
            return _table(part, dealt(*ids, counts, strips))
        cells = ids[0] % side * side + ids[1] % side
        return _table(part, [(rows["row"][0].as_py(), column, cells, counts)])

    return add


def _often(side: int, least: int) -> Callable:
    """The last parts of a tile or strip to the phrases that occur often."""

    def add(rows: pa.Table) -> pa.Table:
        _, ids, counts = summed(rows, side)
        kept = np.stack(ids, axis=1)[counts >= least]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * len(ids), pa.int32()), pa.array(kept.reshape(-1)))
        return pa.table([lists, pa.array(counts[counts >= least])], names=["ids", "n"])

    return add


def _dense(state: DataFrame, parts: int) -> np.ndarray:
    """Tiles that the mean chunk has ``DENSE`` pairs on. Chunks with few pairs on a tile are left out of
    the decision, which changes how pairs are counted and not which."""
    sizes = state.mapInArrow(lean(_tile_sizes(SIDE, DENSE // 4)), "tile long, size long").groupBy("tile").agg(F.sum("size").alias("size"))
    # Bounded: no more tiles than the mean chunk holds times DENSE.
    return np.array(sorted(row.tile for row in sizes.where(F.col("size") >= DENSE * parts).collect()), np.int64)


def frequent(state: DataFrame, length: int, least: int) -> DataFrame:
    """(ids, n): the words of phrases one word longer than ``length`` that occur often."""
    parts, total = state.agg(F.count("*"), F.sum("places")).first()
    dense = _dense(state, parts) if length == 1 else np.zeros(0, np.int64)
    most = 1 << ((total or 0) // STRIP_PAIRS).bit_length()  # strips of the whole table
    strips = min(MERGED, most)
    part = F.pmod(F.xxhash64("chunk"), F.lit(parts)).alias("part")
    tables = state.select("words", "phrases", part).mapInArrow(lean(_count(length, dense, strips, SIDE)), TILE_DDL)
    while parts > MERGED:
        strips = min(strips * MERGED, most)
        group = F.floor(F.col("part") / MERGED).alias("group")
        tables = tables.groupBy("row", "col", group).applyInArrow(lean_group(_add(strips, MERGED, SIDE)), TILE_DDL)
        parts = -(-parts // MERGED)
    return tables.groupBy("row", "col").applyInArrow(lean_group(_often(SIDE, least)), "ids array<long>, n long")


def _list_hashes(lists: pa.ListArray) -> np.ndarray:
    ids = lists.flatten().to_numpy()
    return phrase_hashes(list(ids.reshape(len(lists), -1).T))


def phrase_counts(documents: DataFrame, text: str, lang: str, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases that occur ``least`` times, and (lang, total) words."""
    rows = documents.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).cast("string").alias("text")
    )
    chunks = write_shared(
        rows.mapInArrow(
            lean(_chunks(CHUNK_BYTES)),
            "chunk long, lang string, n_words long, words array<string>, counts binary, places binary",
        ),
        "phrase-chunks",
    )
    chunks, own = chunks.where("words IS NOT NULL"), chunks.where("places IS NOT NULL")
    totals = chunks.groupBy("lang").agg(F.sum("n_words").alias("total"))
    words = chunks.select("lang", "words", "counts").mapInArrow(lean(_word_counts), "lang string, word string, n long")
    counts = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    known = ranked(counts, ["lang", "word"], "words-ranked")
    first = known.select("id", "lang", F.col("word").alias("phrase"), "n")
    found = [first.withColumn("size", F.lit(1)).drop("id")]
    level, length = first.withColumn("ids", F.array("id")), 1
    most, others = head(known)
    marks = sieve(others.select("lang", "word"), lambda lang, word: word_hashes(lang.to_pylist(), word.to_pylist()))
    held = chunks.select("chunk", "lang", "words")
    ids = held.mapInArrow(lean(_head_rows(most)), "chunk long, ids binary")
    held = held.mapInArrow(lean(_word_rows(most, marks)), "chunk long, lang string, local long, word string")
    answers = held.join(others.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "local", "id")
    own = own.select("chunk", F.col("places").alias("words"))
    state = together([own, answers, ids]).groupBy("chunk").applyInArrow(lean_group(_first_state), STATE)
    while True:
        state = write_shared(state, "phrase-state")
        known = write_shared(frequent(state, length, least), "phrases-frequent")
        left = level.select(F.col("ids").alias("head"), "lang", F.col("phrase").alias("left"))
        right = first.select(F.col("id").alias("tail"), F.col("phrase").alias("right"))
        level = write_shared(
            known.join(left, F.slice("ids", 1, length) == F.col("head"))
            .join(right, F.element_at("ids", -1) == F.col("tail"))
            .select("ids", "lang", F.concat_ws(" ", "left", "right").alias("phrase"), "n"),
            "phrases",
        )
        length += 1
        found.append(level.withColumn("size", F.lit(length)).drop("ids"))
        if length == longest or level.isEmpty():
            return reduce(DataFrame.union, found), totals
        marks = sieve(known.select("ids"), _list_hashes)
        state = state.mapInArrow(lean(_next_state(length - 1, marks)), STATE)


def _words(phrase: str, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words or more: lang, phrase, a, l, r, n, score by the cut that scores lowest."""
    cuts = phrases.where("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select(
        "lang", "phrase", F.col("n").alias("a"), "k",
        _words("phrase", F.lit(1), F.col("k")).alias("left"), _words("phrase", F.col("k") + 1, F.col("size")).alias("right"),
    )
    sized = phrases.select("lang", "phrase", "n")
    cuts = cuts.join(sized.toDF("lang", "left", "l"), ["lang", "left"]).join(sized.toDF("lang", "right", "r"), ["lang", "right"])
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    score = F.call_function("div", F.lit(1000) * wide["a"] * wide["n"], wide["l"] * wide["r"])
    cuts = cuts.join(totals.withColumnRenamed("total", "n"), "lang").withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m")
    )
    return best.select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")


def parts_of_longer(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): phrases of two words or more that stand in longer ones, with their largest count."""
    size = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("part")
    rows = phrases.where("size > 2").select("lang", "phrase", "size", "n", size)
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part") + 1)))
    rows = rows.select("lang", _words("phrase", F.col("first"), F.col("part")).alias("phrase"), "n")
    return rows.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(
    documents: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    reported: int = REPORTED,
) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Texts (A-Z in lower case) are cut into pieces at ``.,;:!?`` and line ends, pieces into words at
    blanks and tabs. ``a`` counts all occurrences of a phrase of 2 to ``longest`` words inside
    pieces, overlapping ones, too; those with ``a >= least`` are candidates. Cut after k words, with ``l``
    and ``r`` the counts of its parts and ``n`` that of all words of the language, a candidate scores
    floor(1000 * a * n / (l * r)); the lowest cut counts, the first of equals. Candidates whose words
    stand inside a longer candidate that is as frequent are dropped. The first ``reported`` of each
    language stay, by score and ``a`` descending, then by phrase.

    A null language is ``und``, a null text empty; repeated rows count as often as they occur, keys are
    not read, nor are other columns, whatever their names. Very long texts are packed in parts that
    end where a piece ends; a piece is held by one task. An empty table, or one without a frequent
    pair, gives an empty result.
    """
    phrases, totals = phrase_counts(documents, text, lang, least, longest)
    phrases = write_shared(phrases, "phrase-counts")
    made = scored(phrases, totals).join(parts_of_longer(phrases), ["lang", "phrase"], "left")
    made = made.where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    made = made.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= reported)
    return made.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
