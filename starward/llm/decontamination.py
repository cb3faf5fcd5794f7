"""Documents that hold a benchmark item, a few words changed: CGK embedding and bit sampling.

Texts are sequences of words (lower case, without punctuation at the ends). The public CGK
embedding walks over a sequence with random bits: coordinate t shows the word under the pointer,
and a bit drawn for (t, word) says whether the pointer moves on. Two sequences with few edits
agree on most coordinates, so edit distance becomes Hamming distance. Bit sampling compares a few
coordinates per repetition. A window of the size of an item starts at every word of every
document; repetitions start their walks at different words of the item, so that edits in one part
do not spoil them all. Coordinates are compared one after the other and windows that agree with no
item stop early, which gives the same candidates as one comparison of all. Candidates are
confirmed by the exact edit distance of the item to the words around the window.

Items too short for a walk, of one to four words, allow no edit: their word sequences are looked up as
they are.

The items go out to the tasks in blocks of at most ``BLOCK_ITEMS``; a larger benchmark takes more
passes over the documents. Nothing but confirmed matches is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starward.llm.packing import lean

BLOCK_ITEMS = 20_000
#: Shortest item of a family of walks: (length of the walk, sampled coordinates, repetitions).
FAMILIES = {16: (14, 5, 20), 8: (7, 5, 12), 5: (5, 3, 4)}
#: Characters of text handled at once, and window starts and candidates handled at once.
SLICE, STARTS, CHECKED = 1 << 20, 1 << 18, 4096
#: Raw words whose numbers a task remembers.
REMEMBERED = 1 << 17
PAD = -1


def clean(word: str) -> str:
    """A word without what is not a letter or digit at its ends; empty if nothing is left."""
    first, last = 0, len(word)
    while first < last and not word[first].isalnum():
        first += 1
    while last > first and not word[last - 1].isalnum():
        last -= 1
    return word[first:last]


def words_of(text: str | None) -> list[str]:
    return [word for word in map(clean, (text or "").lower().split()) if word]


class Vocabulary(dict):
    """Raw words to numbers: those of items from 1 on, all others 0, bare punctuation ``PAD``."""

    def __init__(self, items: list[list[str]]):
        self.items: dict[str, int] = {}
        for item in items:
            for word in item:
                self.items.setdefault(word, len(self.items) + 1)

    def __missing__(self, raw: str) -> int:
        word = clean(raw)
        number = self.items.get(word, 0) if word else PAD
        if len(self) >= REMEMBERED:
            self.clear()
        self[raw] = number
        return number


@dataclass
class Walk:
    """One repetition: bits of every word, sampled coordinates and the keys of the items."""

    bits: np.ndarray
    coordinates: list[int]
    first: np.ndarray  # which words may stand at coordinate 0
    keys: list[np.ndarray]  # sorted keys after each later coordinate
    items: np.ndarray  # items in the order of the last keys
    offsets: np.ndarray  # and where their walks start

    def states(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """After each coordinate: the places in ``starts`` still in the race, and their keys."""
        at = np.flatnonzero(self.first[words[starts]])
        pointer, key, step = starts[at], words[starts[at]].astype(np.uint64), 0
        for coordinate, known in zip(self.coordinates, self.keys, strict=True):
            while step < coordinate:
                pointer = pointer + ((self.bits[words[pointer]] >> np.uint32(step)) & np.uint32(1))
                step += 1
            key = combine(key, words[pointer])
            fine = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key)
            at, pointer, key = at[fine], pointer[fine], key[fine]
        yield at, key


def combine(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return key + word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def sequences(words: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """Keys of sequences given word by word."""
    key = words[0].astype(np.uint64)
    for word in words[1:]:
        key = combine(key, word)
    return key


def build_walk(seed: int, length: int, samples: int, share: float, items: list[np.ndarray], which: list[int], size: int) -> Walk:
    """``share``: where in an item, from its first to its last possible place, walks start."""
    random = np.random.default_rng(seed)
    bits = random.integers(0, 1 << length, size + 1, dtype=np.uint32)
    coordinates = sorted(random.choice(np.arange(1, length), samples - 1, replace=False).tolist())
    offsets = np.array([int(share * (len(items[k]) - length)) for k in which])
    pointer, step, word, keys = offsets.copy(), 0, None, []
    flat, start = np.concatenate([items[k] for k in which]), np.cumsum([0, *(len(items[k]) for k in which[:-1])])
    word = flat[start + pointer]
    first = np.zeros(size + 2, bool)
    first[word] = True
    first[PAD] = False
    key = word.astype(np.uint64)
    for coordinate in coordinates:
        while step < coordinate:
            pointer = pointer + ((bits[flat[start + pointer]] >> np.uint32(step)) & np.uint32(1))
            step += 1
        key = combine(key, flat[start + pointer])
        keys.append(np.unique(key))
    order = np.argsort(key, kind="stable")
    keys[-1] = key[order]
    return Walk(np.append(bits, np.uint32(0)), coordinates, first, keys, np.array(which)[order], offsets[order])


class Searcher:
    """The items of one block, and the windows of texts that match them."""

    def __init__(self, items: list[list[str]], ratio: float):
        self.vocabulary = Vocabulary(items)
        self.items = [np.array([self.vocabulary.items[w] for w in item], np.int32) for item in items]
        self.allowed = np.array([int(ratio * len(item)) for item in items], np.int64)
        self.walks = []
        known = sorted(FAMILIES, reverse=True)
        for shortest in known:
            which = [
                k for k, item in enumerate(items) if next((s for s in known if s <= len(item)), None) == shortest
            ]
            length, samples, repetitions = FAMILIES[shortest]
            for n in range(repetitions) if which else ():
                share = n / max(repetitions - 1, 1)
                self.walks.append(
                    build_walk(1000 * shortest + n, length, samples, share, self.items, which, len(self.vocabulary.items))
                )
        # Items shorter than any walk: sorted keys of whole sequences, by length.
        self.short: list[tuple[int, np.ndarray, np.ndarray]] = []
        for length in range(1, min(FAMILIES)):
            which = [k for k, item in enumerate(items) if len(item) == length]
            if which:
                keys = sequences(np.stack([self.items[k] for k in which], axis=1))
                order = np.argsort(keys, kind="stable")
                self.short.append((length, keys[order], np.array(which)[order]))

    def numbers(self, text: str) -> np.ndarray:
        raw = text.lower().split()
        found = np.fromiter(map(self.vocabulary.__getitem__, raw), np.int32, len(raw))
        return found[found != PAD]

    def candidates(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(item, first word the item would have) rows of windows that agree with an item."""
        found = []
        for begin in range(0, len(words), STARTS):
            starts = np.arange(begin, min(begin + STARTS, len(words)))
            for walk in self.walks:
                for at, key in walk.states(words, starts):
                    left = np.searchsorted(walk.keys[-1], key)
                    right = np.searchsorted(walk.keys[-1], key, "right")
                    rows = np.repeat(np.arange(len(at)), right - left)
                    which = np.arange(len(rows)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + left[rows]
                    found.append(np.stack([walk.items[which], starts[at[rows]] - walk.offsets[which]], axis=1))
        for length, known, items in self.short:
            ends = len(words) - length + 1
            for begin in range(0, ends, STARTS):
                starts = np.arange(begin, min(begin + STARTS, ends))
                key = sequences([words[starts + k] for k in range(length)])
                left, right = np.searchsorted(known, key), np.searchsorted(known, key, "right")
                rows = np.repeat(np.arange(len(key)), right - left)
                which = np.arange(len(rows)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + left[rows]
                found.append(np.stack([items[which], starts[rows]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, first, end) of the best match of each text and item."""
        own = [self.numbers(text) for text in texts]
        gap = np.full(max(FAMILIES) + 1, PAD, np.int32)
        words = np.concatenate([part for one in own for part in (one, gap)]) if own else gap
        sizes = np.array([len(one) for one in own], np.int64)
        starts = np.cumsum(sizes + len(gap)) - sizes - len(gap)
        found = self.candidates(words, starts + sizes)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item in np.unique(found[:, 0]):
            first = found[found[:, 0] == item, 1]
            member = np.zeros(len(self.vocabulary.items) + 2, bool)
            member[self.items[item]] = True
            text = np.searchsorted(starts, np.maximum(first, 0), "right") - 1
            for k in range(0, len(first), CHECKED):
                low = first[k : k + CHECKED] - self.allowed[item]
                places = low[:, None] + np.arange(len(self.items[item]) + 2 * self.allowed[item])
                where = text[k : k + CHECKED]
                inside = (places >= starts[where][:, None]) & (places < (starts + sizes)[where][:, None])
                around = np.where(inside, words[np.clip(places, 0, len(words) - 1)], PAD)
                # Words of the item are needed for all but the allowed edits.
                enough = member[around].sum(axis=1) >= len(self.items[item]) - self.allowed[item]
                around, low, where = around[enough], low[enough], where[enough]
                edits, begin, end = closest(self.items[item], around)
                for row in np.flatnonzero(edits <= self.allowed[item]).tolist():
                    base = int(low[row] - starts[where[row]])
                    match = (int(edits[row]), base + int(begin[row]), base + int(end[row]))
                    pair = (int(where[row]), int(item))
                    best[pair] = min(best.get(pair, match), match)
        for (text, item), match in best.items():
            yield text, item, *match


def closest(item: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edit distance of the item to any run of words in each row; first and end of that run.

    Every cell holds distance and where the run began as one number, so that ties take the
    smallest beginning and the minimum runs along whole rows.
    """
    width = around.shape[1] + 1
    scale = 1 << 20
    places = np.arange(width)
    cells = np.broadcast_to(places, (len(around), width)).astype(np.int64)
    for word in item:
        stay = np.empty_like(cells)
        stay[:, 0] = cells[:, 0] + scale
        change = cells[:, :-1] + np.where(around == word, 0, scale)
        np.minimum(cells[:, 1:] + scale, change, out=stay[:, 1:])
        stay -= places * scale
        np.minimum.accumulate(stay, axis=1, out=stay)
        cells = stay + places * scale
    end = np.argmin(cells, axis=1)
    least = cells[np.arange(len(cells)), end]
    return least >> 20, least & (scale - 1), end


def _search(items, ratio: float) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words = items.value
        searcher = Searcher(words, ratio)
        for batch in batches:
            keys, texts, size = [], [], 0
            for n, (key, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True), 1):
                keys.append(key)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= SLICE or n == batch.num_rows:
                    rows = list(searcher.search(texts))
                    text_, item, *numbers = zip(*rows, strict=True) if rows else [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([keys[k].as_py() for k in text_], batch.column(0).type),
                            pa.array([ids[k] for k in item], pa.int64()),
                            *[pa.array(n, pa.int64()) for n in numbers],
                        ],
                        names=["key", "item", "edits", "first", "end"],
                    )
                    keys, texts, size = [], [], 0

    return search


def _clean(items, ratio: float, text: int) -> Callable:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(items.value[1], ratio)
        for batch in batches:
            fine, texts, size = np.ones(batch.num_rows, bool), [], 0
            for n, value in enumerate(batch.column(text).cast(pa.string()), 1):
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size >= SLICE or n == batch.num_rows:
                    hit = [n - len(texts) + found[0] for found in searcher.search(texts)]
                    fine[hit] = False
                    texts, size = [], 0
            yield batch.filter(pa.array(fine))

    return clean


def _sent(documents: DataFrame, benchmark: DataFrame, item: str, item_text: str) -> Iterator:
    """The items as broadcasts of at most ``BLOCK_ITEMS`` items of some words."""
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    blocks = -(-items.count() // BLOCK_ITEMS) or 1
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        kept = [(row.item, words) for row in own if (words := words_of(row.text))]
        yield documents.sparkSession.sparkContext.broadcast(([n for n, _ in kept], [w for _, w in kept]))


def keep_uncontaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    ratio: float = 0.15,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of ``documents``, unchanged, in which ``contaminated`` finds no item.

    Decided row by row, where the row is: nothing is shuffled. Null and empty texts stay, rows of
    any key are rows of their own, very long texts are read whole by one task. An empty benchmark
    keeps all rows, an empty table gives an empty result.
    """
    for sent in _sent(documents, benchmark, item, item_text):
        documents = documents.mapInArrow(
            lean(_clean(sent, ratio, documents.columns.index(text))), documents.schema
        )
    return documents


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    ratio: float = 0.15,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item found in it: key, item, edits, first_word, end_word.

    An item is in a document if some run of its words is at most ``ratio`` times the item's number
    of words away in edit distance of words (places count words that have a letter or digit).
    Items of fewer than seven words allow no edit, so they match where their words stand. Items
    without a word match nothing, nor do null and empty texts; very long texts are read whole by one
    task. Rows that repeat a key or an item count as one; the best match stays. Null
    keys and items are keys. Other columns are not read, whatever their names. Empty tables give
    an empty result.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = [
        rows.mapInArrow(lean(_search(sent, ratio)), f"key {kind}, item long, edits long, first long, end long")
        for sent in _sent(documents, benchmark, item, item_text)
    ]
    every = reduce(DataFrame.union, found)
    best = every.groupBy("key", "item").agg(F.min(F.struct("edits", "first", "end")).alias("m"))
    return best.select(
        F.col("key").alias(key),
        F.col("item").alias(item),
        "m.edits",
        F.col("m.first").alias("first_word"),
        F.col("m.end").alias("end_word"),
    )
