"""Arrays and byte strings packed into compressed binaries, so that shuffles move few bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from starward.sources.shared import write_shared

CODEC = pa.Codec("zstd", compression_level=3)


def deflate(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + CODEC.compress(data, asbytes=True)


def inflate(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return CODEC.decompress(data[8:], decompressed_size=size, asbytes=True) if size else b""


def pack(values: np.ndarray) -> bytes:
    """Numbers of fixed width, byte plane by byte plane: equal high bytes compress well."""
    width = values.dtype.itemsize
    return deflate(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(inflate(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers, as differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def pack_strings(strings: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, strings), np.uint32, len(strings))
    return deflate(len(strings).to_bytes(8, "little") + sizes.tobytes() + b"".join(strings))


def unpack_strings(data: bytes) -> list[bytes]:
    raw = inflate(data)
    count = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, np.uint32, count, 8), dtype=np.int64) + 8 + 4 * count
    starts = [8 + 4 * count, *ends[:-1].tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)] if count else []


def chunk_number(count: int) -> int:
    """A number no other task of the same stage gives out."""
    return (TaskContext.get().partitionId() << 32) + count


def buckets_for(spark: SparkSession, amount: int | None, per_bucket: int) -> int:
    """Enough buckets for ``per_bucket`` each, and for every shuffle partition to have one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(amount or 0) // per_bucket))


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def lean(work: Callable) -> Callable:
    """``work`` over Arrow batches, giving back what the allocators keep when a task ends.

    A worker waits for its next task beside the executor's heap; what it keeps is lost to both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def lean_group(work: Callable) -> Callable:
    """``work`` over the rows of a group, giving back what the allocators keep after each."""

    def run(rows: pa.Table) -> pa.Table:
        try:
            return work(rows)
        finally:
            give_back()

    return run


#: Bytes of rows in one file of a stored table.
FILE_BYTES = 32 << 20


def stored(df: DataFrame, label: str, rows: int, width: int) -> DataFrame:
    """``write_shared`` of at most ``rows`` rows of about ``width`` bytes, in few files.

    The last stage runs in as many tasks as there will be files, one per core at least.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return write_shared(df.coalesce(max(cores, rows * width // FILE_BYTES)), label)


def together(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of different kinds under one schema, so that one shuffle brings them together."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first
