"""Near-duplicate documents: HyperMinHash sketches, banding, corrected estimate, exact check.

1. One pass over the texts gives each document the fingerprint of its set of word shingles and a
   HyperMinHash sketch: shingles are dealt to registers by hash, a register keeps the leading-zero
   count and ten mantissa bits of the smallest hash. Empty registers borrow from full ones.
2. Documents with equal sets fall into classes; only their smallest ids go on.
3. Bands of registers find candidates. Each member of a band is checked with the band's smallest
   document. Linked documents form components, and only bands whose members are in different
   components are looked into again: their members are compared with each other inside tasks, in
   blocks of bounded size, first by registers and then, if a partner is likely, by full sets; only
   the links that join components leave the task. So a group of thousands of near copies costs
   one check per member, no link between different components is lost, and no list of pairs is
   made.
4. A pair is checked on the full sets if its sizes allow the similarity and the estimate from the
   registers, corrected for chance collisions, is not far below it.

The number of bands follows from the threshold so that a pair exactly at it is missed with
probability ``MISS`` at most; the estimate may fall short by ``SIGMAS`` standard errors. Sets so
small that one element more is too much can only equal others and stay out of the bands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starward.llm.components import connected_components, local_roots
from starward.llm.packing import lean, stored
from starward.llm.word_hashes import Words, mix
from starward.sources.shared import write_shared

ROWS, MISS, SIGMAS, MANTISSA = 8, 1e-6, 5, 10
#: Bands a class should have at most: each is a row that is shuffled.
MOST_BANDS = 50
#: Bytes of text that are hashed at once.
SLICE = 4 << 20
#: Members of a band, and shingles of members, that are compared with as many others in one task.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 20
#: Fixed value of the published approximation of chance collisions of HyperMinHash registers.
CHANCE = 0.169919487159739093975315012348
SALTS = [np.uint64(0x8E9D5A3F1C2B4D67), np.uint64(0xD1B54A32D192ED03)]


def bands_of(threshold: float, rows: int) -> int:
    """Bands of so many registers that miss a pair at the threshold with probability MISS."""
    return ceil(log(MISS) / log1p(-(threshold**rows))) if threshold < 1 else 1


def rows_for(threshold: float) -> int:
    """Registers of a band: the most, up to ``ROWS``, for which ``MOST_BANDS`` bands suffice."""
    return max((rows for rows in range(1, ROWS + 1) if bands_of(threshold, rows) <= MOST_BANDS), default=1)


def bands_for(threshold: float) -> int:
    return bands_of(threshold, rows_for(threshold))


def deviation(threshold: float, registers: int, smaller):
    """Standard error of the estimate for pairs at the threshold; ``smaller`` set of the two.

    The variance of independent registers, half as much again because registers borrow, and a
    term for sets of a few elements, whose borrowed registers hang together (as measured).
    """
    return (threshold * (1 - threshold) * (1.5 / registers + 0.5 / smaller**2)) ** 0.5


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and texts (bytes, A-Z in lower case; null: empty), a few megabytes at a time."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys.append(key)
            texts.append((text.as_py() or "").encode().lower())
            size += len(texts[-1])
            if size >= SLICE:
                yield keys, texts
                keys, texts, size = [], [], 0
        yield keys, texts


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a shorter text is one shingle."""
    found = Words(texts)
    rolled = found.rolling(words)
    for start, size in zip(found.starts.tolist(), found.sizes.tolist(), strict=True):
        if size >= words:
            yield np.unique(rolled[start : start + size - words + 1])
        elif size:
            whole = np.append(found.hashes[0][start : start + size], SALTS[0] * np.array([size], np.uint64))
            yield mix(np.bitwise_xor.accumulate(mix(whole * np.arange(1, 2 * size + 3, 2, np.uint64)))[-1:])
        else:
            yield np.zeros(0, np.uint64)


@cache
def detours(registers: int) -> np.ndarray:
    """Where an empty register looks, one row per attempt; the last rows are its neighbours."""
    attempts, own = np.arange(64)[:, None], np.arange(registers)
    jumps = mix((attempts * registers + own).astype(np.uint64) + SALTS[1]) % np.uint64(registers)
    steps = (own + np.arange(1, registers)[:, None]) % registers
    return np.concatenate([jumps.astype(np.int64), steps])


def sketch(shingles: np.ndarray, registers: int) -> np.ndarray:
    """HyperMinHash registers of a set: leading zeros (as an exponent) and mantissa, 16 bits."""
    mixed = mix(shingles ^ SALTS[0])
    where = (mixed % np.uint64(registers)) << np.uint64(41)
    sorted_ = np.sort(where | (mix(shingles ^ SALTS[1]) >> np.uint64(23)))
    at = (sorted_ >> np.uint64(41)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    least = (sorted_[first] & np.uint64((1 << 41) - 1)).astype(np.float64) + 1
    compressed = (least.view(np.uint64) >> np.uint64(52 - MANTISSA)) - np.uint64(1023 << MANTISSA)
    made = np.zeros(registers, np.uint16)
    full = np.zeros(registers, bool)
    made[at[first]], full[at[first]] = compressed, True
    empty = np.flatnonzero(~full)
    for detour in detours(registers):
        if not len(empty):
            break
        at = detour[empty]
        made[empty[full[at]]] = made[at[full[at]]]
        empty = empty[~full[at]]
    return made


def _sketches(words: int, registers: int) -> Callable:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["key", "n_shingles", "print", "registers"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            rows = []
            for own in shingle_sets(texts, words):
                if len(own):
                    made = sketch(own, registers).tobytes()
                    rows.append((len(own), xxhash.xxh3_128_digest(own.tobytes()), made))
                else:
                    rows.append((0, None, None))
            columns = [keys, *zip(*rows, strict=True)] if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names
            )

    return build


def _sets(words: int) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            sets = list(shingle_sets(texts, words))
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(own.tobytes()) for own in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["key", "print", "shingles"],
            )

    return build


def _likely(threshold: float, registers: int) -> Callable:
    """Pairs whose corrected estimate does not fall short of the threshold by too much."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, registers)
                for k in ("r_a", "r_b")
            )
            n_a, n_b = (batch.column(k).to_numpy().astype(float) for k in ("n_a", "n_b"))
            chance = CHANCE * 2.0**-MANTISSA * 4 * n_a * n_b / (n_a + n_b) ** 2
            same = (left == right).mean(axis=1)
            estimate = (same - chance) / (1 - chance)
            spread = deviation(threshold, registers, np.minimum(n_a, n_b))
            fine = estimate >= threshold - SIGMAS * spread
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    return keep


class Band:
    """Members of one band, or of two blocks of it, and who of them may be similar."""

    def __init__(self, rows: pa.Table, percent: int, bands: int, registers: int):
        self.percent, self.bands, self.registers = percent, bands, registers
        self.at, low, high = (rows[name][0].as_py() for name in ("at", "low", "high"))
        self.rep, self.component, self.block, self.sizes = (
            rows[name].to_numpy() for name in ("rep", "component", "block", "n")
        )
        self.whole = low == high
        data = b"".join(rows["sketch"].to_pylist())
        self.sketches = np.frombuffer(data, np.uint16).reshape(-1, registers)

    def likely(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with later members of other components that the estimate does not rule out.

        A pair is looked at in the first of its common bands only.
        """
        order, t = np.arange(len(self.rep)), self.percent / 100
        for x in order:
            fine = (order > x) & (self.component != self.component[x])
            if not self.whole:
                fine &= self.block != self.block[x]
            smaller, larger = np.minimum(self.sizes, self.sizes[x]), np.maximum(self.sizes, self.sizes[x])
            ys = np.flatnonzero(fine & (smaller * 100 >= larger * self.percent))
            same = self.sketches[ys] == self.sketches[x]
            equal = same.reshape(-1, self.bands, self.registers // self.bands).all(axis=2)
            estimate = same.mean(axis=1) + SIGMAS * deviation(t, self.registers, smaller[ys])
            ys = ys[equal[:, self.at] & ~equal[:, : self.at].any(axis=1) & (estimate >= t)]
            if len(ys):
                yield int(x), ys


def _suspects(percent: int, bands: int, registers: int) -> Callable:
    def suspects(rows: pa.Table) -> pa.Table:
        found = np.zeros(rows.num_rows, bool)
        for x, ys in Band(rows, percent, bands, registers).likely():
            found[x] = True
            found[ys] = True
        return rows.select(["band", "at", "rep", "component", "n"]).filter(pa.array(found))

    return suspects


def _across(percent: int, bands: int, registers: int) -> Callable:
    """Links between members of different components of one band, as few as join them."""

    def across(rows: pa.Table) -> pa.Table:
        band = Band(rows, percent, bands, registers)
        lists = pa.concat_arrays(rows["shingles"].chunks)
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes)
        known, shingles = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        marked, left, right = np.zeros(len(known), bool), [], []
        for x, ys in band.likely():
            own = shingles[ends[x] - sizes[x] : ends[x]]
            marked[own] = True
            upto = np.cumsum(sizes[ys])
            places = np.repeat(ends[ys] - upto, sizes[ys]) + np.arange(upto[-1])
            common = np.add.reduceat(marked[shingles[places]].astype(np.int64), upto - sizes[ys])
            marked[own] = False
            ys = ys[common * 100 >= (sizes[ys] + sizes[x] - common) * percent]
            left.append(np.full(len(ys), x))
            right.append(ys)
        a, b = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
        root = local_roots(a, b, len(band.rep))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(band.rep[root[moved]]), "b": pa.array(band.rep[moved])})

    return across


class _Finder:
    def __init__(self, documents: DataFrame, words: int, percent: int):
        self.documents, self.words, self.percent = documents, words, percent
        self.bands, self.in_band = bands_for(percent / 100), rows_for(percent / 100)
        self.registers = self.bands * self.in_band
        self.rows = write_shared(
            documents.mapInArrow(
                lean(_sketches(words, self.registers)),
                "key long, n_shingles long, print binary, registers binary",
            ),
            "sketches",
        )
        self.n_rows, self.n_members = self.rows.count(), 0
        self.classes = stored(
            self.rows.where("print IS NOT NULL AND key IS NOT NULL")
            .groupBy("print")
            .agg(
                F.min("key").alias("rep"),
                F.first("n_shingles").alias("n_shingles"),
                F.first("registers").alias("registers"),
            ),
            "classes",
            self.n_rows,
            2 * self.registers,
        )

    def band_members(self) -> DataFrame:
        """(band, at, rep, leader, size) of bands of two classes or more."""
        width = 2 * self.in_band
        hashed = F.transform(
            F.sequence(F.lit(0), F.lit(self.bands - 1)),
            lambda b: F.xxhash64(b, F.substring("registers", b * width + 1, F.lit(width))),
        )
        open_sets = self.classes.where(F.col("n_shingles") * 100 >= (F.col("n_shingles") + 1) * self.percent)
        bands = open_sets.select(F.posexplode(hashed).alias("at", "band"), "rep")
        shared = bands.groupBy("band").agg(F.min("rep").alias("leader"), F.count("rep").alias("size"))
        members = write_shared(bands.join(shared.where("size > 1"), "band"), "bands")
        self.n_members = members.count()
        return members

    def sets(self, keys: DataFrame) -> DataFrame:
        """(key, shingles) of the classes named by their smallest keys."""
        named = keys.join(self.classes.select(F.col("rep").alias("key"), "print"), "key")
        needed = self.few(named, "needed", 24)
        made = (
            self.documents.join(needed.select("key").distinct(), "key", "left_semi")
            .mapInArrow(lean(_sets(self.words)), "key long, print binary, shingles array<long>")
            .join(needed, ["key", "print"], "left_semi")
            .dropDuplicates(["key", "print"])
        )
        return self.few(made.select("key", "shingles"), "sets", 8000)

    def few(self, df: DataFrame, label: str, width: int) -> DataFrame:
        """Stored; no more rows than bands have members."""
        return stored(df, label, self.n_members, width)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        sizes = self.classes.select("rep", "n_shingles", "registers")
        fit = (
            pairs.join(sizes.toDF("a", "n_a", "r_a"), "a")
            .join(sizes.toDF("b", "n_b", "r_b"), "b")
            .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        )
        likely = self.few(
            fit.mapInArrow(lean(_likely(self.percent / 100, self.registers)), "a long, b long"), "likely", 16
        )
        sets = self.sets(likely.select(F.col("a").alias("key")).union(likely.select("b")).distinct())
        common = F.size(F.array_intersect("s_a", "s_b"))
        return self.few(
            likely.join(sets.toDF("a", "s_a"), "a")
            .join(sets.toDF("b", "s_b"), "b")
            .where(common * 100 >= (F.size("s_a") + F.size("s_b") - common) * self.percent)
            .select("a", "b")
            .distinct(),
            "links",
            16,
        )

    def links(self) -> DataFrame:
        """Links (a, b) between classes, enough of them to connect all that are similar."""
        members = self.band_members()
        first = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
        links = self.confirmed(first.distinct())
        known = connected_components(links)
        members = (
            members.where("size > 2")
            .join(known.withColumnRenamed("node", "rep"), "rep", "left")
            .select("band", "at", "rep", F.coalesce("component", "rep").alias("component"))
        )
        return links.union(self.across(self.suspects(members)))

    def suspects(self, members: DataFrame) -> DataFrame:
        """The members of bands that are likely to be similar to a member of another component."""
        counts = members.groupBy("band", "component").agg(F.count("rep").alias("n"))
        parts = counts.groupBy("band").agg(F.count("n").alias("parts")).where("parts > 1")
        own = self.classes.select("rep", F.col("n_shingles").alias("n"), F.col("registers").alias("sketch"))
        mixed = self.few(members.join(parts, "band", "left_semi"), "mixed", 40)
        found = self.blocked(mixed, F.count("rep") / BLOCK_ROWS).join(own, "rep")
        return self.few(
            found.groupBy("band", "low", "high")
            .applyInArrow(
                _suspects(self.percent, self.bands, self.registers),
                "band long, at int, rep long, component long, n long",
            )
            .distinct(),
            "suspects",
            40,
        )

    def across(self, suspects: DataFrame) -> DataFrame:
        """Links (a, b) that join the components of suspects of the same band."""
        sets = self.sets(suspects.select(F.col("rep").alias("key")).distinct())
        own = sets.withColumnRenamed("key", "rep").join(
            self.classes.select("rep", F.col("registers").alias("sketch")), "rep"
        )
        rows = self.blocked(suspects, F.sum("n") / BLOCK_SHINGLES).join(own, "rep")
        found = rows.groupBy("band", "low", "high").applyInArrow(
            _across(self.percent, self.bands, self.registers), "a long, b long"
        )
        return self.few(found.distinct(), "links", 16)

    def blocked(self, members: DataFrame, blocks: Column) -> DataFrame:
        """Members dealt to pairs of blocks (low, high) of their band, so that every two meet."""
        counts = members.groupBy("band").agg(F.ceil(blocks).alias("blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        return (
            members.join(counts, "band")
            .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
            .withColumn("other", other)
            .withColumn("low", F.least("block", "other"))
            .withColumn("high", F.greatest("block", "other"))
            .drop("blocks", "other")
        )

    def components(self) -> DataFrame:
        """(key, component_id) of keys in links or in classes of several keys."""
        owned = (
            self.rows.where("print IS NOT NULL AND key IS NOT NULL")
            .select("key", "print")
            .join(self.classes.select("print", "rep"), "print")
            .groupBy("key")
            .agg(F.min("rep").alias("rep"), F.collect_set("rep").alias("reps"))
        )
        owned = stored(owned, "owned", self.n_rows, 32)
        same_key = owned.where(F.size("reps") > 1).select(F.col("rep").alias("a"), F.explode("reps").alias("b"))
        known = connected_components(self.links().union(same_key)).withColumnRenamed("node", "rep")
        return owned.join(known, "rep", "left").select(
            "key", F.coalesce("component", "rep").alias("component_id")
        )


def near_duplicates(
    documents: DataFrame,
    words: int = 5,
    percent: int = 80,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``documents``: key, n_shingles, component_id, kept.

    A document's set are its distinct shingles of ``words`` words (A-Z in lower case; words are
    runs without ASCII white space); a shorter text is one shingle, an empty or null text has none
    and links with nothing. Documents are linked if 100 * common >= ``percent`` * union.
    ``component_id`` is the smallest key reachable, ``kept`` says that it is the row's own key.
    Keys are integers; rows that repeat a key are one document with several texts, so they share a
    component. A null key links with nothing and is kept under a null component. Other columns
    are not read, whatever their names. An empty table gives an empty result.
    """
    rows = documents.select(
        F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")
    )
    finder = _Finder(rows, words, percent)
    found = finder.components()
    component = F.coalesce("component_id", "key")
    return finder.rows.join(found, "key", "left").select(
        F.col("key").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"),
    )
