from __future__ import annotations

import os

import pytest

from starward.llm.queries import QUERIES
from starward.sources.shared import shared_folder

#: Queries that write tables on the way.
WRITE = [name for name in QUERIES if name.split("_")[0] in ("op2", "op3", "op5", "op7", "op8", "op10", "op11", "op12", "op13")]


@pytest.mark.parametrize("name", WRITE)
def test_only_the_result_stays_in_the_shared_folder(spark, name):
    folder = f"{shared_folder(spark).removeprefix('file:')}/starward"

    def tables():
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    before = tables()
    result = QUERIES[name](spark, "/root/testdata/sf0.001")
    left = tables() - before
    assert len(left) == 1
    assert result.count() > 0 and tables() - before == left
