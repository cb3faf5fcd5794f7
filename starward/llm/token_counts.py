"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

Texts are cut into segments of bounded size and the segments into pieces, always at safe
boundaries: between a visible character and white space after it. The byte-level pre-tokenizer
never joins characters across such a place and looks ahead only from white space, so the counts
of the pieces add up to the count of the text. Segments are gathered into batches of about ``BATCH_BYTES``,
however they are spread over rows, and a piece that comes again is encoded once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
#: Distinct pieces a worker remembers, and the longest piece it remembers.
CACHE_PIECES, CACHE_LENGTH = 600_000, 100

#: Unicode white space, as the pre-tokenizer knows it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
#: A blank after white space is no safe place.
BEFORE_BLANK = [f"{space} " for space in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", space)]
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def pieces(text: str) -> list[str]:
    """The text cut at safe boundaries: before every blank where that is safe, as is usual."""
    if any(before in text for before in BEFORE_BLANK):
        return PIECE.findall(text)
    return text.replace(" ", "\0 ").split("\0") if "\0" not in text else PIECE.findall(text)


def segments(text: str, size: int) -> Iterator[tuple[str, int]]:
    """The text in parts of about ``size`` bytes, cut at safe boundaries only, with their bytes."""
    data, start, at = text.encode(), 0, 0
    while len(data) - at > size:
        whole = len(data[at : at + size].decode(errors="ignore"))  # characters in the next bytes
        cut = SAFE.search(text, start + max(whole, 1))
        if not cut:
            break
        part = text[start : cut.start()]
        n_bytes = len(part.encode())
        yield part, n_bytes
        start, at = cut.start(), at + n_bytes
    yield text[start:] if start else text, len(data) - at


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a file, one thread; loaded once in a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceCounter:
    """Counts tokens of texts; a piece that is not remembered is encoded once per batch."""

    def __init__(self, path: str):
        self.encoder, self.known = encoder(path), {}

    def learn(self, pieces: set[str]) -> None:
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known, new = {}, pieces
        new = list(new)
        lengths = map(len, self.encoder.encode_batch_fast(new, add_special_tokens=False))
        self.known.update(zip(new, lengths, strict=True))

    def count(self, texts: list[str]) -> list[int]:
        split = [pieces(text) for text in texts]
        self.learn({piece for own in split for piece in own})
        counts = [sum(map(self.known.__getitem__, own)) for own in split]
        for piece in [piece for piece in self.known if len(piece) > CACHE_LENGTH]:
            del self.known[piece]
        return counts


def token_counts(
    documents: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 1024,
) -> DataFrame:
    """One row per row of ``documents``: key, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the path of a byte-level ``.json`` tokenizer on every executor. The library's
    defaults hold: the string of a special token inside a text is that token; none is added,
    nothing is cut or padded. A null or empty text has 0 bytes and 0 tokens. Rows that repeat
    or have a null key stay rows of their own; other columns are not read, whatever their names.
    A very long text is read whole by one task, a segment at a time. An empty table gives an empty result.
    """

    def count(batches):
        counter = PieceCounter(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_bytes, n_tokens = [0] * len(texts), [0] * len(texts)
            rows, parts, size = [], [], 0
            for row, whole in enumerate(texts):
                for part, part_bytes in segments(whole or "", BATCH_BYTES):
                    rows.append(row)
                    parts.append(part)
                    n_bytes[row] += part_bytes
                    size += part_bytes
                    if size >= BATCH_BYTES:
                        for at, n in zip(rows, counter.count(parts), strict=True):
                            n_tokens[at] += n
                        rows, parts, size = [], [], 0
            for at, n in zip(rows, counter.count(parts), strict=True):
                n_tokens[at] += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["key", "n_bytes", "n_tokens"],
            )

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
