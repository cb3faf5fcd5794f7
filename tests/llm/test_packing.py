from __future__ import annotations

import pyarrow as pa
import pytest

from starward.llm.packing import lean


def batch(n):
    return pa.RecordBatch.from_arrays([pa.array(range(n))], names=["n"])


def test_lean_passes_batches_on_and_ends_work_early():
    ended = []

    def work(batches):
        try:
            for one in batches:
                yield one.slice(1)
        finally:
            ended.append(True)

    assert [b.num_rows for b in lean(work)(iter([batch(3), batch(1)]))] == [2, 0]
    started = lean(work)(iter([batch(2), batch(2)]))
    assert next(started).num_rows == 1
    started.close()
    assert ended == [True, True]
    assert list(lean(work)(iter([]))) == []


def test_lean_hands_errors_on():
    def work(batches):
        yield next(batches)
        raise ValueError("stop")

    with pytest.raises(ValueError, match="stop"):
        list(lean(work)(iter([batch(1)])))
