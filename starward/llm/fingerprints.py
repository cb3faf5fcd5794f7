"""Document fingerprints of improbable features, in chained Bloom filters.

Every window of 64 bytes has an entropy, in thousandths of the largest possible. Over the whole corpus
some entropies are common and some are rare; ``rarity`` ranks them. In a text, the rarest window of
any 64 that follow each other gains a point, and windows with ``POINTS`` points are its features: they
depend on the text around them only, so copies of a passage select the same ones wherever it stands.

Features are hashed into filters of 256 bytes, five bits each; a filter takes ``FEATURES`` and then
the next one begins, so a fingerprint grows with its text, and so do the passages that two share. Two
filters are as alike as the bits they share beyond what chance would give, as a share of the most
they could; a filter of the shorter chain counts with its best partner in the longer one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starward.llm.word_hashes import mix
from starward.sources.shared import write_shared

#: Bytes of a window, windows of which one gains a point, points of a feature.
WINDOW, NEIGHBOURS, POINTS = 64, 64, 16
#: Entropies are told apart to a thousandth; below ``WEAK`` they say little and rank last.
BINS, WEAK = 1000, 100
#: Bytes of a filter, features in it, bits per feature, and the share of the way from the overlap
#: by chance to the largest one that two filters must pass to count at all.
FILTER, FEATURES, HASHES, CUTOFF = 256, 160, 5, 0.1
BITS = FILTER * 8
#: Bytes of text handled at once, bytes whose windows are counted in cache, filters compared at once.
SLICE, BLOCK, COMPARED = 1 << 20, 1 << 16, 1024
SCALE = 1 << 16


@cache
def _terms() -> np.ndarray:
    """n log2 n in whole numbers, for n bytes of one value in a window."""
    n = np.arange(WINDOW + 1)
    return np.rint(n * np.log2(np.maximum(n, 1)) * SCALE).astype(np.int64)


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy of every window of some bytes, in thousandths; exact sums, so equal ones are equal."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    parts = [_block(data[k : k + BLOCK + WINDOW - 1]) for k in range(0, len(data) - WINDOW + 1, BLOCK)]
    return np.concatenate(parts)


def _block(data: np.ndarray) -> np.ndarray:
    """A step of one byte changes two counts: that of the byte that leaves and of the one that comes."""
    n, terms = len(data), _terms()
    after, before = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for k in range(1, WINDOW):
        same = (data[:-k] == data[k:]).view(np.uint8)
        after[:-k] += same
        before[k:] += same
    change = np.diff(terms, prepend=0)
    sums = np.empty(n - WINDOW + 1, np.int64)
    sums[0] = terms[np.bincount(data[:WINDOW], minlength=256)].sum()
    sums[1:] = change[before[WINDOW:]] - change[after[: n - WINDOW]]
    np.cumsum(sums, out=sums)
    return (terms[WINDOW] - sums) * BINS // terms[WINDOW]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes one after the other, where each text starts and its size."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes


def inside(starts: np.ndarray, sizes: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which places of the joined bytes start a run of ``width`` that stays within one text."""
    edge = np.zeros(total + 1, np.int8)
    fits = sizes >= width
    np.add.at(edge, starts[fits], 1)
    np.add.at(edge, starts[fits] + sizes[fits] - width + 1, -1)
    return np.cumsum(edge[:-1]).astype(bool)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[str]]]:
    """Rows from a place of a batch on, with texts of a slice in all (null: empty)."""
    for batch in batches:
        texts, size, begin = [], 0, 0
        for n, text in enumerate(batch.column(batch.num_columns - 1), 1):
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= SLICE or n == batch.num_rows:
                yield batch, begin, texts
                texts, size, begin = [], 0, n


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BINS + 1, np.int64)
    for _, _, texts in _slices(batches):
        data, starts, sizes = joined([text.encode() for text in texts])
        found = entropies(data)
        total += np.bincount(found[inside(starts, sizes, WINDOW, len(data))[: len(found)]], minlength=BINS + 1)
    bins = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(total[bins])], names=["entropy", "n"])


def rarity(documents: DataFrame, text: str = "text") -> list[int]:
    """The rank of every entropy, 0 the rarest, from all windows of all texts; weak ones rank last.

    What reaches the driver is one number per entropy, a thousand at most.
    """
    rows = documents.select(F.col(text).cast("string").alias("text"))
    counts = rows.mapInArrow(_histogram, "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n"))
    known = {row.entropy: row.n for row in counts.collect()}
    order = sorted(range(BINS + 1), key=lambda b: (b < WEAK, known.get(b, 0), b))
    ranks = [0] * (BINS + 1)
    for rank, entropy in enumerate(order):
        ranks[entropy] = rank
    return ranks


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The distinct feature hashes of every text, in the order of the text.

    A text with fewer windows than neighbours has its rarest one; one shorter than a window is a
    feature itself, an empty one has none.
    """
    data, starts, sizes = joined(texts)
    found = entropies(data)
    shift = np.int64(40)
    keys = (ranks[found] << shift) | np.arange(len(found))
    chosen = [np.zeros(0, np.int64)]
    least, width = keys, 1
    while width < NEIGHBOURS and len(least):
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    valid = inside(starts, sizes, WINDOW + NEIGHBOURS - 1, len(data))[: len(least)]
    best = least[valid] & ((1 << shift) - 1)
    points = np.bincount(best, minlength=1)
    many = np.flatnonzero(points)
    # Fewer places than points: all of them must agree.
    places = sizes[np.searchsorted(starts, many, "right") - 1] - (WINDOW + NEIGHBOURS - 2) if len(many) else many
    chosen.append(many[points[many] >= np.minimum(POINTS, places)])
    few = np.flatnonzero((sizes >= WINDOW) & (sizes < WINDOW + NEIGHBOURS - 1))
    chosen.append(np.array([keys[starts[k] : starts[k] + sizes[k] - WINDOW + 1].min() & ((1 << shift) - 1) for k in few], np.int64))
    at = np.sort(np.concatenate(chosen))
    hashes = _hashed(data[at[:, None] + np.arange(WINDOW)]) if len(at) else np.zeros(0, np.uint64)
    cuts = np.searchsorted(at, starts)
    ends = np.searchsorted(at, starts + sizes)
    made = []
    for k, (a, b) in enumerate(zip(cuts.tolist(), ends.tolist(), strict=True)):
        own = hashes[a:b]
        if 0 < sizes[k] < WINDOW:
            padded = np.frombuffer(texts[k].ljust(WINDOW, b"\0"), np.uint8)[None, :]
            own = mix(_hashed(padded) + np.uint64(sizes[k]))
        first = np.unique(own, return_index=True)[1]
        made.append(own[np.sort(first)])
    return made


def _hashed(windows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of ``WINDOW`` bytes."""
    words = np.ascontiguousarray(windows).view(np.uint64)
    made = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        made = mix(made * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
    return made


def digest(hashes: np.ndarray) -> str:
    """The chain of filters as text: the number of features, then the filters in base 64."""
    filters = -(-len(hashes) // FEATURES)
    bits = np.zeros(filters * BITS, bool)
    place = np.arange(len(hashes)) // FEATURES * BITS
    for k in range(HASHES):
        part = (hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)
        bits[place + part.astype(np.int64)] = True
    return f"{len(hashes)}:{base64.b64encode(np.packbits(bits).tobytes()).decode()}"


def _chain(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and bits of every filter."""
    count, _, data = fingerprint.partition(":")
    raw = np.frombuffer(base64.b64decode(data), np.uint8)
    sizes = np.full(len(raw) // FILTER, FEATURES)
    if len(sizes):
        sizes[-1] = int(count) - FEATURES * (len(sizes) - 1)
    return sizes, np.unpackbits(raw).reshape(-1, BITS)


def likeness(one: str, other: str) -> float:
    """How alike two fingerprints are, 0 to 1, whichever comes first; equal ones are 1."""
    if one == other:
        return 1.0
    chains = sorted((_chain(one), _chain(other)), key=lambda c: (len(c[0]), c[0].sum(), c[1].tobytes()))
    (n, short), (m, long) = chains
    if not len(n):
        return 0.0
    best = np.zeros(len(n))
    for a in range(0, len(n), COMPARED):
        for b in range(0, len(m), COMPARED):
            x, y = short[a : a + COMPARED], long[b : b + COMPARED]
            shared = x.astype(np.float32) @ y.astype(np.float32).T
            most = np.minimum(x.sum(axis=1, dtype=np.int64)[:, None], y.sum(axis=1, dtype=np.int64))
            left, right = n[a : a + COMPARED, None] * HASHES, m[None, b : b + COMPARED] * HASHES
            empty = 1 - 1 / BITS
            chance = BITS * (1 - empty**left - empty**right + empty ** (left + right))
            floor = chance + CUTOFF * (most - chance)
            score = np.where(shared > floor, (shared - floor) / np.maximum(most - floor, 1e-9), 0.0)
            best[a : a + COMPARED] = np.maximum(best[a : a + COMPARED], np.minimum(score, 1.0).max(axis=1))
    return float((best * n).sum() / n.sum())


def digests(texts: list[str], ranks: np.ndarray) -> list[str]:
    return [digest(own) for own in features([text.encode() for text in texts], ranks)]


def fingerprints(
    documents: DataFrame, ranks: list[int] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``documents``: key, n_chars, fingerprint. Nothing is shuffled.

    ``ranks`` are those of ``rarity``, of this corpus if not given; fingerprints compare under the
    same ranks only. Equal texts have equal fingerprints. Null and empty texts have a fingerprint
    without features. Very long texts are read whole, in one task. Repeated rows and null keys stay
    rows of their own; other columns are not read, whatever their names. An empty table gives an
    empty result.
    """
    ranks = rarity(documents, text) if ranks is None else ranks
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(ranks, np.int64)
        for batch, begin, texts in _slices(batches):
            columns = [batch.column(0).slice(begin, len(texts)), pa.array(map(len, texts), pa.int64()), pa.array(digests(texts, table))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_chars", "fingerprint"])

    return rows.mapInArrow(build, f"key {kind}, n_chars long, fingerprint string").withColumnRenamed("key", key)


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(keys: list, texts: list[str], ranks: np.ndarray) -> dict[str, list]:
    """All but the last of some texts that follow each other, held against their edited texts and the next."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own = digests(texts + changed, ranks)
    prints, altered = own[: len(texts)], own[len(texts) :]
    return {
        "key": keys[:-1],
        "n_chars": [len(text) for text in texts[:-1]],
        "edited_sha256": [hashlib.sha256(text.encode()).hexdigest() for text in changed],
        "fingerprint": prints[:-1],
        "edited_fingerprint": altered,
        "near_edited": [likeness(a, b) for a, b in zip(prints, altered, strict=False)],
        "near_next": [likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)],
    }


def _types(key: pa.DataType) -> dict[str, pa.DataType]:
    text = {name: pa.string() for name in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return {"key": key, "n_chars": pa.int64(), **text, "near_edited": pa.float64(), "near_next": pa.float64()}


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(ranks: list[int]) -> Callable:
    """Sorted rows against the row that follows; the ends of a partition come out with their texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = np.array(ranks, np.int64), TaskContext.get().partitionId()
        keys, texts, size, first = [], [], 0, None
        kind = pa.null()

        def made(columns: dict[str, list], end: str | None, text: str | None) -> pa.RecordBatch:
            n = len(columns["key"])
            types = _types(kind)
            arrays = [pa.array(columns.get(name, [None] * n), t) for name, t in types.items()]
            arrays += [pa.array([end] * n, pa.string()), pa.array([part] * n, pa.int64()), pa.array([text] * n, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=[*types, "end", "part", "text"])

        for batch in batches:
            kind = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(key.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if first is None:
                    first = keys[0], texts[0]
                if size >= SLICE and len(texts) > 1:
                    yield made(_compared(keys, texts, table), None, None)
                    keys, texts, size = keys[-1:], texts[-1:], len(texts[-1])
        if first is not None:
            if len(texts) > 1:
                yield made(_compared(keys, texts, table), None, None)
            yield made({"key": [first[0]]}, "first", first[1])
            yield made({"key": keys[-1:]}, "last", texts[-1])

    return build


def _two(ranks: list[int]) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(ranks, np.int64)
        for batch in batches:
            types = _types(batch.column(0).type)
            for key, text, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = _compared([key, None], [text, following], table)
                yield pa.RecordBatch.from_arrays([pa.array(found[n], t) for n, t in types.items()], names=list(types))

    return build


def edited_likeness(
    documents: DataFrame, ranks: list[int] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """How well fingerprints hold when half a text changes: key, n_chars, ``RESULT``.

    Documents follow each other by descending key, null keys last, rows of one key by a hash of
    their texts; after the last comes the first. A document's edited text is its own with the last
    floor(n_chars / 2) code points replaced by as many (or all) of the next one. ``near_edited``
    and ``near_next`` are the likeness of its fingerprint to that text's and to the next document's.

    The texts move once, into sorted partitions, where the next document is the next row; only the
    first and last of every partition meet in a join. Null texts are empty. A single document
    follows itself. Rows that are equal in key and text may stand in any order, and a partition
    may begin among them. Very long texts are held whole by one task. Other columns are not read,
    whatever their names. An empty table gives an empty result.
    """
    ranks = rarity(documents, text) if ranks is None else ranks
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    order = [F.desc_nulls_last("key"), F.asc("hash")]
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*order, "row").sortWithinPartitions(*order, "text").select("key", "text")
    found = write_shared(
        ordered.mapInArrow(_in_order(ranks), f"key {kind}, {RESULT}, end string, part long, text string"), "fingerprints"
    )
    columns = ["key", *[name.split()[0] for name in RESULT.split(", ")]]
    # One short row per partition.
    parts = found.where("end = 'first'").select("part")
    following = F.lead("part").over(Window.orderBy("part"))
    begin = parts.agg(F.min("part")).scalar()
    follows = parts.select("part", F.coalesce(following, begin).alias("next"))
    firsts = found.where("end = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = found.where("end = 'last'").select("part", "key", "text")
    borders = lasts.join(follows, "part").join(firsts, "next").select("key", "text", "following")
    borders = borders.mapInArrow(_two(ranks), f"key {kind}, {RESULT}")
    return found.where("end IS NULL").select(*columns).union(borders.select(*columns)).withColumnRenamed("key", key)
