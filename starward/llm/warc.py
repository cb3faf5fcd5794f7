"""Merkle fixity audit of WARC archives.

``warc_records`` turns pages into WARC/1.1 response records in archives of ``records`` records, each
with its offset; ``archives`` puts the bytes of an archive together and ``split_archives`` finds the
records in them again. A tree is built for every archive from the digests of its records in the
order of their offsets: a leaf covers one record, a node ``FAN`` neighbours of the level below and
so a range of offsets, the root the whole archive. ``audit`` compares the roots of two replicas
and goes down only where digests differ, a join per level over the children of the differing
nodes, until it has the records that differ, are missing or are too many.

A node is addressed by archive, level and number. A group holds the records below one top node,
``FAN ** LEVELS`` at most, and archives are filled task by task, so no key can make one large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starward.llm.packing import chunk_number
from starward.sources.shared import write_shared

RECORDS, FAN, LEVELS = 1000, 16, 3
FIELDS = ["archive", "place", "offset", "length", "digest"]
PLACED = {"archive": pa.int64(), "place": pa.int64(), "offset": pa.int64(), "record": pa.binary()}


def response(url: str, body: str) -> bytes:
    """One record. Its date is fixed, so that the same page makes the same bytes."""
    payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body.encode()
    name = hashlib.sha1(url.encode() + b" " + payload).hexdigest()
    head = [
        "WARC/1.1",
        "WARC-Type: response",
        f"WARC-Record-ID: <urn:sha1:{name}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(payload)}",
    ]
    return "\r\n".join([*head, "", ""]).encode() + payload + b"\r\n\r\n"


def _placed(records: int) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, offset = 0, 0
        for batch in batches:
            rows = []
            for url, body in zip(batch.column(1), batch.column(2), strict=True):
                record = response(url.as_py() or "", body.as_py() or "")
                offset = offset if number % records else 0
                rows.append((chunk_number(number // records), number % records, offset, record))
                offset += len(record)
                number += 1
            columns = zip(*rows, strict=True) if rows else [[]] * len(PLACED)
            made = [pa.array(c, kind) for c, kind in zip(columns, PLACED.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["key", *PLACED])

    return place


def warc_records(
    pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", records: int = RECORDS
) -> DataFrame:
    """(key, archive, place, offset, record): one record per page, written once.

    Null urls and bodies are empty, null and repeated keys are kept. Other columns are not read,
    whatever their names. An empty table makes no archive.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string"), F.col(body).cast("string"))
    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(_placed(records), f"key {kind}, archive long, place long, offset long, record binary")
    return write_shared(made, "warc").withColumnRenamed("key", key)


def archives(records: DataFrame) -> DataFrame:
    """(archive, data): the records of each archive one after the other.

    An archive is held by one task, like the file it is; null records are left out. No records make
    no archives.
    """
    own = F.array_sort(F.collect_list(F.struct("offset", "record")))
    joined = F.aggregate("own", F.lit(b""), lambda data, r: F.concat(data, r["record"]))
    return records.groupBy("archive").agg(own.alias("own")).select("archive", joined.alias("data"))


def split_archives(whole: DataFrame) -> DataFrame:
    """(archive, place, offset, record) of archives given as (archive, data), such as files.

    A record ends where its Content-Length says; what cannot be read as a record up to the end of
    the archive is kept as one last record, so that no byte escapes the audit.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                offset, place, data = 0, 0, data or b""
                while offset < len(data):
                    end = record_end(data, offset)
                    rows.append((archive, place, offset, data[offset:end]))
                    offset, place = end, place + 1
            columns = zip(*rows, strict=True) if rows else [[]] * len(PLACED)
            made = [pa.array(c, kind) for c, kind in zip(columns, PLACED.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=list(PLACED))

    return whole.select("archive", "data").mapInArrow(split, "archive long, place long, offset long, record binary")


def record_end(data: bytes, offset: int) -> int:
    head = data.find(b"\r\n\r\n", offset)
    for line in data[offset:head].split(b"\r\n") if head >= 0 else ():
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            end = head + 4 + int(value) + 4
            if data[end - 4 : end] == b"\r\n\r\n":
                return end
    return len(data)


def fixity(records: DataFrame) -> DataFrame:
    """The digest of every record with its place and range of offsets: the leaves of the trees.

    One row per row of ``records``, whatever its other columns; written once, since both the tree and
    the last step of an audit read it. A null record has no digest and stands for a record that
    neither side can read; an empty one, or a very long one, is a record like any other.
    """
    length = F.length("record").cast("long")
    leaves = records.select(
        "archive", "place", "offset", F.coalesce(length, F.lit(0).cast("long")).alias("length"), F.sha2("record", 256).alias("digest")
    )
    return write_shared(leaves, "leaves")


def node(children: list[tuple]) -> tuple[int, int, str]:
    """(offset, length, digest) of the node above (place, offset, length, digest) neighbours."""
    listed = "|".join(f"{p}:{o}:{n}:{d}" for p, o, n, d in children)
    first, end = min(c[1] for c in children), max(c[1] + c[2] for c in children)
    return first, end - first, hashlib.sha256(listed.encode()).hexdigest()


NODES = "level int, archive long, place long, offset long, length long, digest string"


def _branches(levels: int) -> Callable:
    """All nodes above the leaves of one branch, level by level: FAN neighbours become one node."""

    def build(rows: pa.Table) -> pa.Table:
        archive = rows["archive"][0].as_py()
        leaves = zip(*(rows[name].to_pylist() for name in FIELDS[1:]), strict=True)
        below, made = sorted(leaves), []
        for level in range(1, levels + 1):
            above: dict[int, list[tuple]] = {}
            for child in below:
                above.setdefault(child[0] // FAN, []).append(child)
            below = [(place, *node(children)) for place, children in above.items()]
            made += [(level, archive, *one) for one in below]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = zip(*made, strict=True) if made else [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["level", *FIELDS])

    return build


def merkle_tree(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes of every level, the leaves first: archive, place, offset, length, digest.

    ``levels`` levels above the leaves hold FAN ** levels records per archive in one root; larger
    archives have several nodes on the top level, which are compared like roots. Leaves move once:
    a group holds those below one top node, FAN ** levels at most, and gives all its levels. These
    are written once, each level to a folder of its own. No leaves make a tree without nodes.
    """
    top = F.floor(F.col("place") / FAN**levels).alias("top")
    nodes = leaves.select(*FIELDS).groupBy("archive", top).applyInArrow(_branches(levels), NODES)
    written = write_shared(nodes.withColumn("stage", F.col("level")), "merkle-tree", partition_by=["stage"])
    inner = [written.where(F.col("stage") == level).select(*FIELDS) for level in range(1, levels + 1)]
    return [leaves.select(*FIELDS), *inner]


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes of one level whose digests differ or that only one side has."""
    on = ["archive", "place"]
    sides = [
        side.select(*on, F.struct("offset", "length", "digest").alias(name))
        for side, name in ((left, "expected"), (right, "found"))
    ]
    joined = sides[0].join(sides[1], on, "full")
    return joined.where(~F.col("expected.digest").eqNullSafe(F.col("found.digest")))


def audit(expected: list[DataFrame], found: list[DataFrame]) -> DataFrame:
    """Records that differ between two trees: archive, place, status and offsets on both sides.

    ``status`` is ``changed``, ``missing`` (not in ``found``) or ``added``. Two empty trees have no
    differences. The differing nodes of a level are written before the next one is looked at: a
    level is scanned from the least to the largest archive with a difference, and only children of
    differing nodes are compared. The trees must have the same number of levels.
    """
    above = None
    for low, high in zip(expected[:0:-1], found[:0:-1], strict=True):
        apart = _differing(_below(low, above), _below(high, above))
        above = write_shared(apart.select("archive", F.col("place").alias("up")), "merkle-branches")
    apart = _differing(_below(expected[0], above), _below(found[0], above))
    gone, new = F.col("found.digest").isNull(), F.col("expected.digest").isNull()
    status: Column = F.when(gone, "missing").when(new, "added").otherwise("changed")
    return apart.select(
        "archive", "place", status.alias("status"),
        F.col("expected.offset").alias("offset"), F.col("expected.length").alias("length"),
        F.col("found.offset").alias("found_offset"), F.col("found.length").alias("found_length"),
    )


def _below(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """The nodes of a level below some of the next; all of them if none are named."""
    if above is None:
        return nodes
    least, largest = above.agg(F.min("archive"), F.max("archive")).first()
    near = nodes.where(F.col("archive").between(F.lit(least).cast("long"), F.lit(largest).cast("long")))
    return near.withColumn("up", F.floor(F.col("place") / FAN)).join(above, ["archive", "up"], "left_semi")
