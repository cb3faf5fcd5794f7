from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of ``documents`` from (doc_id, text) pairs, in a few partitions."""

    def build(rows, partitions=3):
        full = [(key, text, "en", "s", None if text is None else len(text)) for key, text in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(partitions)

    return build


@pytest.fixture
def tiny(spark, tmp_path):
    """A folder with the given tables, as queries read them."""

    def build(**tables):
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return build
