"""Groups of spelling variants: words of a corpus within one edit, found on a relational trie.

Words are counted over the whole corpus. Every distinct word is a strand read forwards and one read
backwards, and both kinds make one trie: the edge table holds a row per (node, letter) with the child,
the word that ends there, the letters that may follow it and the lengths of what hangs below. A
frontier of states (strand, position, node, edits) goes down level by level, one join of the
frontier with the edges of that level at a time. A state without an edit takes one, by an edge of
another letter or by leaving a letter of its own out; a state with one edit follows its own letters
only. States that end with one edit where a word ends are neighbours.

Of two words that differ by one edit, either the first or the second half is the same, so a strand
enters the trie at the node of its first half, forwards for edits in the second half and backwards
for those in the first. That node is deep, where a trie is sparse: states near the root, which
every word would share, never arise. Being near has two directions: only the longer word leaves a
letter out and only the smaller letter is replaced; pairs are turned round at the end.

A node is a 64-bit hash of its prefix, so every pair is compared letter by letter in the end. No
group is gathered: a node has at most as many edges as there are letters, a word at most as many
neighbours as edits, and a join with very many states in one node is split like any skewed join.
Words of ``LONG`` letters or more would need as many levels; they are matched by hashes of all
their shortened forms instead, which takes one row per letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starward.sources.shared import write_shared

#: Every so many (document, run) hashes, a letter is deleted from the run: planted misspellings.
TYPOS = 31
#: Letters of the shortest word, and of words that are matched without the trie.
SHORTEST, LONG = 7, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)


def word_counts(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = 2
) -> DataFrame:
    """(word, n): lower-case words of ``shortest`` letters or more with ``least`` occurrences or more.

    Runs of letters (A-Z, a-z, U+00C0 to U+00FF), of which only A-Z are lower-cased. With h the
    crc32 of ``<key>:<run>``, a run loses its letter number h % length if h is divisible by
    ``TYPOS``; under a null key nothing is lost. Runs are counted before they move.
    """
    runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    rows = documents.select(F.col(key).cast("string").alias("key"), F.explode(runs).alias("run"))
    ascii_only = F.length("run") == F.octet_length("run")
    plain = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    rows = rows.select("key", plain.alias("run"))
    rows = rows.select("run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.col("h") % TYPOS == 0, shorter).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).where(F.length("word") >= shortest)
    return counts.groupBy("word").agg(F.count("word").alias("n")).where(F.col("n") >= least)


def _letter(place: Column) -> Column:
    """Code point of the letter of ``own`` at a place (from 0); 0 behind the end."""
    return F.ascii(F.substring("own", place + 1, F.lit(1)))


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.cast("int"))


def _node(depth: Column) -> Column:
    return F.xxhash64("side", F.substring("own", F.lit(1), depth))


def strands(words: DataFrame) -> DataFrame:
    """(own, side, start): every word forwards and backwards, with the depth of its first half."""
    both = words.select(F.col("word").alias("own"), F.lit(0).alias("side")).union(
        words.select(F.reverse("word"), F.lit(1))
    )
    return both.withColumn("start", F.floor((F.length("own") + F.col("side")) / 2).cast("int"))


def trie_edges(strand: DataFrame, shallowest: int) -> DataFrame:
    """One row per edge from ``shallowest`` on: depth, node, letter, child and what is below.

    ``letters`` has a bit for every letter after the child (modulo 64), ``lengths`` one for every
    number of letters that strands have left there; ``ends`` is the strand that ends there.
    """
    depth = F.explode(F.sequence(F.lit(shallowest), F.length("own") - 1)).alias("depth")
    rows = strand.where(F.length("own") > shallowest).select("own", "side", depth)
    left = F.length("own") - F.col("depth") - 1
    return (
        rows.select(
            "depth",
            _node(F.col("depth")).alias("node"),
            _letter(F.col("depth")).alias("letter"),
            _node(F.col("depth") + 1).alias("child"),
            F.when(left > 0, _bit(_letter(F.col("depth") + 1) % 64)).otherwise(F.lit(0)).alias("letters"),
            _bit(left).alias("lengths"),
            F.when(left == 0, F.col("own")).alias("ends"),
        )
        .groupBy("depth", "node", "letter")
        .agg(
            F.first("child").alias("child"),
            F.bit_or("letters").alias("letters"),
            F.bit_or("lengths").alias("lengths"),
            F.max("ends").alias("ends"),
        )
    )


#: Edits of a state: none yet, a letter replaced, a letter left out.
NONE, REPLACED, LEFT_OUT = 0, 1, 2


def _level(states: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """States one level further down: own, side, edits, node, ends."""
    edits, letter = F.col("edits"), F.col("letter")
    next_ = F.lit(depth) + F.when(edits == LEFT_OUT, 1).otherwise(0)

    def fits(place: Column) -> Column:
        """The edge is followed by what the strand has behind ``place``."""
        left = F.length("own") - place - 1
        ahead = (left == 0) | (F.col("letters").bitwiseAND(_bit(_letter(place + 1) % 64)) != 0)
        return (left >= 0) & (F.col("lengths").bitwiseAND(_bit(left)) != 0) & ahead

    follows = (edits > NONE) & (letter == _letter(next_)) & fits(next_)
    replaces = (edits == NONE) & (letter > _letter(next_)) & fits(next_)
    leaves = (edits == NONE) & (letter == _letter(next_ + 1)) & fits(next_ + 1)
    # An edge may do for both, when a letter is left out and when it is replaced.
    moved = F.array_compact(
        F.array(
            F.when(follows, edits),
            F.when(replaces, F.lit(REPLACED)),
            F.when(leaves, F.lit(LEFT_OUT)),
        )
    )
    joined = states.join(edges.drop("depth"), "node").where(follows | replaces | leaves)
    made = joined.select("own", "side", F.explode(moved).alias("edits"), F.col("child").alias("node"), "ends")
    left = F.length("own") - F.lit(depth + 1) - F.when(F.col("edits") == LEFT_OUT, 1).otherwise(0)
    return made.select("own", "side", "edits", "node", F.when(left == 0, F.col("ends")).alias("ends"), (left > 0).alias("open"))


def _by_trie(words: DataFrame, longest: int, shortest: int) -> list[DataFrame]:
    """(a, b) of words of up to ``longest`` letters, level by level."""
    strand = write_shared(strands(words), "strands")
    shallowest = shortest // 2
    edges = trie_edges(strand, shallowest)
    path = write_shared(edges.withColumn("level", F.col("depth")), "trie-edges", partition_by=["level"])
    found, frontier = [], None
    for depth in range(shallowest, longest):
        own = strand.where((F.col("start") <= depth) & (F.length("own") > depth))
        states = own.select("own", "side", F.lit(NONE).alias("edits"), _node(F.lit(depth)).alias("node"))
        if frontier is not None:
            states = states.union(frontier.where("open").select("own", "side", "edits", "node"))
        level = path.where(F.col("level") == depth).drop("level")
        frontier = write_shared(_level(states, level, depth), "trie-frontier")
        found.append(frontier.where("ends IS NOT NULL").select("own", "ends", "side"))
    # The last letter is left out where the shorter strand ends: no edge is taken.
    shorter = strand.select("own", "side", F.expr("substring(own, 1, length(own) - 1)").alias("ends"))
    found.append(shorter.join(strand.select(F.col("own").alias("ends"), "side"), ["ends", "side"]).select("own", "ends", "side"))
    turned = [F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c)).alias(to) for c, to in (("own", "a"), ("ends", "b"))]
    return [df.select(*turned) for df in found]


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word the hash of the whole (place -1) and of the word without each of its letters."""
    for batch in batches:
        for word, id_ in zip(batch.column(0), batch.column(1), strict=True):
            points = np.frombuffer(word.as_py().encode("utf-32-le"), np.uint32).astype(np.uint64)
            powers = np.full(len(points), STEP, np.uint64)
            powers[0] = 1
            upto = np.zeros(len(points) + 1, np.uint64)
            np.cumsum((points + np.uint64(1)) * np.cumprod(powers), out=upto[1:])
            without = upto[:-1] + (upto[-1] - upto[1:]) * np.uint64(BACK)
            hashes = np.concatenate([upto[-1:], without]).view(np.int64)
            places = np.arange(-1, len(points), dtype=np.int32)
            ids = pa.array(np.full(len(hashes), id_.as_py()), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(places), pa.array(hashes)], names=["id", "place", "hash"])


def _without(word: str, place: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def _by_shortened(words: DataFrame) -> DataFrame:
    """(a, b) of words within one edit, from equal hashes of their shortened forms."""
    named = write_shared(words.select("word", F.xxhash64("word").alias("id")), "long-words")
    rows = write_shared(named.mapInArrow(_shortened, "id long, place int, hash long"), "shortened")
    cut, whole = rows.where("place >= 0"), rows.where("place < 0").select(F.col("id").alias("other"), "hash")
    replaced = cut.join(cut.select(F.col("id").alias("other"), "place", "hash"), ["hash", "place"]).where("id < other")
    both = cut.join(whole, "hash").select("id", "other", "place", F.lit(True).alias("shorter")).union(
        replaced.select("id", "other", "place", F.lit(False))
    )
    pairs = both.join(named.select("id", F.col("word").alias("a")), "id").join(
        named.select(F.col("id").alias("other"), F.col("word").alias("b")), "other"
    )
    kept = F.when(F.col("shorter"), F.col("b")).otherwise(_without("b", F.col("place")))
    return pairs.where((_without("a", F.col("place")) == kept) & (F.col("a") != F.col("b"))).select("a", "b")


def near_words(words: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(a, b): all pairs of distinct words that differ by one inserted, deleted or replaced letter.

    Both directions of each pair. ``words`` has a column ``word`` of distinct words of ``shortest``
    letters or more.
    """
    length = F.length("word")
    longest, all_ = words.agg(F.max(F.when(length <= LONG, length)), F.max(length)).first()
    parts = _by_trie(words.where(length <= LONG).select("word"), longest or 0, shortest)
    if (all_ or 0) > LONG:
        parts.append(_by_shortened(words.where(length >= LONG).select("word")))
    pairs = reduce(DataFrame.union, parts)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Hashes of nodes may be equal by chance: the letters decide. They start alike and end alike.
    one_edit = F.levenshtein("a", "b", 1) == 1
    pairs = pairs.where((F.length("a") > LONG) | (F.length("b") > LONG) | one_edit)
    pairs = write_shared(pairs, "near-words")
    return pairs.union(pairs.select("b", "a"))


def spelling_variants(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, times: int = 10
) -> DataFrame:
    """One row per word of ``word_counts``: word, form, root, n, n_near, form_n.

    Two words are near if they differ by one inserted, deleted or replaced letter. ``form`` is the
    near word of largest ``n`` (ties: the smallest in code-point order) if that is ``times`` the
    word's own n or more, else null; ``form_n`` its n; ``n_near`` the number of near words. ``root``
    follows forms to the last, and is the word itself if it has none.

    Null and empty texts have no words, a null key plants no misspelling, repeated rows count as
    often as they occur. Texts and runs of any length are read whole: a run of a million letters
    is a word like any other. Other columns are not read, whatever their names. An empty table
    gives an empty result.
    """
    words = write_shared(word_counts(documents, key, text, shortest), "word-counts")
    near = near_words(words, shortest)
    sized = near.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    best = sized.groupBy("a").agg(
        F.count("b").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best")
    )
    rows = words.join(best, F.col("word") == F.col("a"), "left")
    formed = -F.col("best.less") >= F.col("n") * times
    rows = write_shared(
        rows.select(
            "word",
            F.when(formed, F.col("best.b")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = _roots(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root): where (word, root) steps lead in the end.

    A form is ``times`` as frequent as its word, so a path has fewer steps than a count has
    digits; every round doubles what a row skips.
    """
    now = write_shared(steps, "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = write_shared(moved, "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now
