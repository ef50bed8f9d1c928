from __future__ import annotations

import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, lang="en"):
        rows = [tuple(r) for r in rows]
        table = pa.table(
            {
                "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                "text": pa.array([r[1] for r in rows], pa.string()),
                "lang": pa.array([lang] * len(rows), pa.string()),
                "source": pa.array([r[2] if len(r) > 2 else "src0" for r in rows], pa.string()),
                "n_chars": pa.array([len(r[1]) if r[1] is not None else None for r in rows], pa.int64()),
            }
        )
        return spark.createDataFrame(table)

    return make
