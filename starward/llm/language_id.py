"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams of 1 to 3 letters, word borders shown
as ``_``. A document gets the language whose profile is closest to its own most frequent n-grams
in out-of-place distance: the sum of differences of ranks, a missing n-gram counting as the length
of the profile. Profiles are learned by aggregations over a sample of labelled documents whose
expected size per language is a parameter; predictions read whole texts, a few megabytes at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starward.llm.packing import lean
from starward.llm.word_hashes import Numbers

#: n-grams in a profile, n-grams of a document that are compared, labelled documents per language.
PROFILE, COMPARED, SAMPLE = 400, 300, 2000
#: Characters of text, and cells of the table of documents by n-grams, handled at once.
SLICE, CELLS = 1 << 19, 1 << 20
UNKNOWN = "und"
SHIFT = np.uint64(21)


def held_out(key: Column) -> Column:
    """A third of the documents, never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def _grams(word: Column) -> Column:
    """All n-grams of a lower-case word with its borders, repeated as they occur."""
    whole = F.concat(F.lit("_"), word, F.lit("_"))

    def of(n: int) -> Column:
        last = F.length(whole) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda k: F.substring(whole, k, F.lit(n))))

    return F.concat(F.filter(of(1), lambda g: g != "_"), of(2), F.coalesce(of(3), F.array().cast("array<string>")))


def learn_profiles(
    documents: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, size: int = PROFILE
) -> dict[str, list[str]]:
    """Language to its ``size`` most frequent n-grams, most frequent first, ties by code point.

    About ``sample`` documents per language are used, chosen by a hash of the text (all, if there
    are fewer); rows without text or language teach nothing. What reaches the driver is one short
    list per language.
    """
    rows = documents.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    # One row per language, as the result; a join by language would deal the texts to a few tasks.
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("lang").alias("n")).collect()}
    if not counts:
        return {}
    n = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) * n < F.lit(1_000_003) * sample)
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    weights = chosen.select("lang", words.alias("word")).groupBy("lang", "word").agg(F.count("word").alias("n"))
    grams = (
        weights.select("lang", "n", F.explode(_grams(F.col("word"))).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list[str]] = {}
    for row in ranked.orderBy("lang", "rank").collect():
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


def code(gram: str) -> int:
    """An n-gram as a number: 21 bits per character, a border as 0, length in the top bits."""
    number = 0
    for letter in gram:
        number = (number << 21) | (0 if letter == "_" else ord(letter))
    return number | (len(gram) << 62 if len(gram) < 3 else 0)


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def token_grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of all tokens, token by token, and how many each token has."""
    joined = " ".join(["", *tokens, "", ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    points[~letters()[points]] = 0
    a, b, c = points[:-2], points[1:-1], points[2:]
    codes = np.stack(
        [a | np.uint64(1 << 62), (a << SHIFT) | b | np.uint64(2 << 62), (a << SHIFT << SHIFT) | (b << SHIFT) | c], axis=1
    )
    valid = np.stack([a > 0, (a > 0) | (b > 0), b > 0], axis=1)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    codes, valid = codes[: sizes.sum()], valid[: sizes.sum()]
    ends = np.cumsum(np.concatenate([[0], valid.sum(axis=1)]))[np.cumsum(sizes)]
    return codes[valid], np.diff(ends, prepend=0)


def ranked_grams(texts: list[str], compared: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, code, rank) of the ``compared`` most frequent n-grams of every text, ties by code."""
    numbers, places, sizes = Numbers(), [], []
    for text in texts:
        tokens = text.lower().split()
        places.append(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)))
        sizes.append(len(tokens))
    if not numbers:
        return
    codes, grams_of = token_grams(list(numbers))
    if not len(codes):
        return
    known, dense = np.unique(codes, return_inverse=True)
    first = np.cumsum(grams_of) - grams_of
    width, n_tokens = len(known), len(numbers)
    step = max(CELLS // width, 1)
    for begin in range(0, len(texts), step):
        own = np.concatenate(places[begin : begin + step])
        text = np.repeat(np.arange(len(sizes[begin : begin + step])), sizes[begin : begin + step])
        pairs, times = np.unique(text * n_tokens + own, return_counts=True)
        text, token = pairs // n_tokens, pairs % n_tokens
        many = grams_of[token]
        at = np.repeat(first[token] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        cells = np.repeat(text * width, many) + dense[at]
        table = np.bincount(cells, np.repeat(times, many), min(step, len(texts) - begin) * width)
        cell = np.flatnonzero(table)
        row = cell // width
        order = np.argsort(row * (1 << 40) - table[cell].astype(np.int64), kind="stable")
        start = np.searchsorted(row, np.arange(row[-1] + 1)) if len(row) else row
        rank = np.arange(len(row)) - start[row]
        best = rank < compared
        yield row[best] + begin, known[cell[order][best] % width], rank[best]


class Profiles:
    """Profiles as one table of ranks."""

    def __init__(self, profiles: dict[str, list[str]]):
        self.names = sorted(profiles)
        coded = [np.array([code(g) for g in profiles[name]], np.uint64) for name in self.names]
        self.known = np.unique(np.concatenate(coded)) if coded else np.zeros(0, np.uint64)
        self.missing = max(map(len, coded), default=1)
        self.ranks = np.full((len(self.known) + 1, len(self.names)), -1, np.int64)
        for k, own in enumerate(coded):
            self.ranks[np.searchsorted(self.known, own), k] = np.arange(len(own))

    def predict(self, texts: list[str], compared: int) -> tuple[list[str], list[float]]:
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.names:
            return languages, scores
        for text, grams, rank in ranked_grams(texts, compared):
            at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
            at = np.where(self.known[at] == grams, at, len(self.known))
            own = self.ranks[at]
            apart = np.where(own < 0, self.missing, np.minimum(np.abs(own - rank[:, None]), self.missing))
            rows, where = np.unique(text, return_inverse=True)
            distance = np.stack([np.bincount(where, apart[:, k]) for k in range(len(self.names))], axis=1)
            best = np.argmin(distance, axis=1)
            least = distance[np.arange(len(rows)), best] / (np.bincount(where) * self.missing)
            for row, k, share in zip(rows.tolist(), best.tolist(), least.tolist(), strict=True):
                languages[row], scores[row] = self.names[k], 1.0 - share
        return languages, scores

    def of(self, column: pa.Array, compared: int) -> tuple[list[str], list[float]]:
        """Languages and scores of a column of texts (null: empty), a slice at a time."""
        made, texts, size = ([], []), [], 0
        for n, text in enumerate(column, 1):
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= SLICE or n == len(column):
                for kept, new in zip(made, self.predict(texts, compared), strict=True):
                    kept += new
                texts, size = [], 0
        return made


def _predict(profiles: dict[str, list[str]], compared: int) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Profiles(profiles)
        for batch in batches:
            made = [pa.array(column, kind) for column, kind in zip(table.of(batch.column(1), compared), (pa.string(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["key", "lang_pred", "score"])

    return predict


def _known(profiles: dict[str, list[str]], compared: int, text: int) -> Callable:
    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Profiles(profiles)
        for batch in batches:
            languages, scores = table.of(batch.column(text).cast(pa.string()), compared)
            fine = [name != UNKNOWN and score > 0 for name, score in zip(languages, scores, strict=True)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return known


def identify(
    documents: DataFrame,
    profiles: dict[str, list[str]],
    key: str = "doc_id",
    text: str = "text",
    compared: int = COMPARED,
) -> DataFrame:
    """One row per row of ``documents``: key, lang_pred, score.

    ``score`` is 1 minus the distance as a share of the largest possible one; ties go to the first
    language by name. A null text or one without a letter is ``und`` with score 0, as is every
    text if there are no profiles. Repeated rows and null keys stay rows of their own; other
    columns are not read, whatever their names. A very long text is a slice of its own, read whole
    by one task. An empty table gives an empty result.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(lean(_predict(profiles, compared)), f"key {kind}, lang_pred string, score double")
    return found.withColumnRenamed("key", key)


def keep_identified(
    documents: DataFrame, profiles: dict[str, list[str]], text: str = "text", compared: int = COMPARED
) -> DataFrame:
    """The rows of ``documents``, unchanged, that ``identify`` gives a language with a score above 0.

    Decided row by row, where the row is: nothing is shuffled. Null texts and texts without a
    letter go; rows of any key stay rows of their own. An empty table, or no profiles, gives an
    empty result.
    """
    return documents.mapInArrow(lean(_known(profiles, compared, documents.columns.index(text))), documents.schema)
