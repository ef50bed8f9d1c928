from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from refload.llm import multi_index as op
from tests.llm.conftest import SF


def plain(rows):
    """n_links and component of each row by comparing every two rows."""
    names = [r["vec_id"] for r in rows]
    unit = [op.unit(r["embedding"]) for r in rows]
    links = {k: set() for k in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i]["label"] is not None and rows[i]["label"] == rows[j]["label"]
            if same and unit[i] and unit[j] and len(unit[i]) == len(unit[j]) and np.dot(unit[i], unit[j]) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    low = dict(enumerate(names))
    while True:
        new = {k: min([low[k], *(low[m] for m in links[k])]) for k in low}
        if new == low:
            break
        low = new
    return sorted((names[k], len(links[k]), low[k], low[k] == names[k]) for k in low)


def frame(spark, rows):
    return spark.createDataFrame(
        pa.table(
            {
                "vec_id": pa.array([r["vec_id"] for r in rows], pa.int64()),
                "embedding": pa.array([r["embedding"] for r in rows], pa.list_(pa.float32())),
                "label": pa.array([r["label"] for r in rows], pa.int32()),
            }
        )
    )


def found(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def test_query_against_brute_force(spark):
    from refload.llm.queries import QUERIES

    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    want = plain(rows)
    assert found(QUERIES["op10_multi_index"](spark, SF)) == want


@pytest.mark.parametrize("block", [5, 1024])
def test_dense_groups_copies_and_blocks(spark, block):
    rng = np.random.default_rng(1)
    center = rng.normal(size=(4, 8))
    made = [c + rng.normal(scale=0.09, size=8) for c in center for _ in range(40)] + [center[0]] * 30
    rows = [{"vec_id": 1000 - k, "embedding": x.astype(np.float32).tolist(), "label": k % 2} for k, x in enumerate(made)]
    assert found(op.near_vectors(frame(spark, rows), recall=1, block=block)) == plain(rows)


def test_default_recall_in_many_dimensions(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 64))
    x = np.concatenate((x, x + rng.normal(scale=0.18, size=x.shape) * rng.random((900, 1))))
    rows = [{"vec_id": k, "embedding": v.astype(np.float32).tolist(), "label": k % 3} for k, v in enumerate(x)]
    want = {w[0]: w[1] for w in plain(rows)}
    got = {g[0]: g[1] for g in found(op.near_vectors(frame(spark, rows)))}
    assert all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.99 * sum(want.values()) > 500
    assert sum(got.values()) % 2 == 0


def test_less_recall_reaches_its_target():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    x = np.concatenate((x, x + rng.normal(scale=0.1, size=x.shape)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for recall in (0.9, 1.0):
        book1, book2, reach = op.fit(x, 12, 0.98, recall)
        (own1, low1), (own2, low2) = op.bounds(x[:, :8], book1), op.bounds(x[:, 8:], book2)
        i, j = np.nonzero(x @ x.T >= 0.98)
        i, j = i[i != j], j[i != j]
        walks = [set(op.multi_sequence(low1[k], low2[k], reach)) for k in range(len(x))]
        hit = np.mean([(own1[b], own2[b]) in walks[a] for a, b in zip(i, j, strict=True)])
        assert hit >= recall
        grid = low1[:, :, None] + low2[:, None, :] <= reach
        assert all(len(w) == g.sum() for w, g in zip(walks, grid, strict=True))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        {"vec_id": 1, "embedding": [1.0, 0.0], "label": 1}, {"vec_id": 2, "embedding": [2.0, 0.0], "label": 1},
        {"vec_id": 3, "embedding": [1.0, -0.0], "label": 2}, {"vec_id": 4, "embedding": [1.0, 0.0], "label": None},
        {"vec_id": 5, "embedding": [0.0, 0.0], "label": 1}, {"vec_id": 6, "embedding": None, "label": 1},
        {"vec_id": 7, "embedding": [nan, 1.0], "label": 1}, {"vec_id": 8, "embedding": [1.0, None], "label": 1},
        {"vec_id": 9, "embedding": [inf, 1.0], "label": 1}, {"vec_id": 10, "embedding": [], "label": 1},
        {"vec_id": 11, "embedding": [3.0, 0.0, 0.0], "label": 1}, {"vec_id": 12, "embedding": [5.0], "label": 1},
        {"vec_id": 13, "embedding": [1e-30, 0.0], "label": 1},
    ]
    assert found(op.near_vectors(frame(spark, rows), recall=1)) == plain(rows)
    nameless = [{"vec_id": None, "embedding": [1.0, 0.0], "label": 1}, *rows[:2], rows[0]]
    got = op.near_vectors(frame(spark, nameless)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == [
        ("1", 2, 1, True), ("1", 2, 1, True), ("2", 2, 1, False), ("None", 0, None, False),
    ]
    assert op.near_vectors(frame(spark, [])).collect() == []
    clash = frame(spark, rows).selectExpr("*", "1 AS id", "2 AS unit", "3 AS a", "4 AS n")
    assert found(op.near_vectors(clash, recall=1)) == plain(rows)
