from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refload.llm import hard_negatives as module
from refload.llm.hard_negatives import HARD_NEGATIVES_SQL, hard_negatives
from refload.llm.queries import QUERIES
from tests.llm.conftest import SF
from tests.oracle import connect, difference


def plain(rows, every=5):
    """(id, label, vector) rows, each anchor against each row."""
    fits = lambda v: v is not None and all(x is not None and math.isfinite(x * 256) for x in v)
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and fits(v)]
    end = lambda x: max(-(2**63), min(2**63 - 1, x))
    score = lambda v, w: end(sum(a * b for a, b in zip(v, w, strict=False)))
    out = []
    for k, (i, label, v) in enumerate(rows):
        if i is None or i % every:
            continue
        others = [(-score(v, w), j is None, j or 0, j, o == label) for n, (j, o, w) in enumerate(rows) if n != k]
        for p, _, _, positive, _ in sorted(x for x in others if x[4])[:5]:
            hard = sorted(x for x in others if not x[4] and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            out += [(i, positive, r + 1, n, -p, -s) for r, (s, _, _, n, _) in enumerate(hard)]
    return sorted(out, key=str)


def given(spark, rows, kind=pa.float64()):
    columns = {"vec_id": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[1] for r in rows], pa.int32())}
    return spark.createDataFrame(pa.table(columns | {"embedding": pa.array([r[2] for r in rows], pa.list_(kind))}))


def found(df, every=5):
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % every == 0).collect()), key=str)


def odd_rows(n=120, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(4, 20))
    rows = [(i, int(i % 3), (base[i % 4] + rng.normal(size=20) * 0.4).round(2).tolist()) for i in range(n)]
    rows += [(5, 0, rows[5][2]), (5, 1, rows[7][2]), (None, 0, rows[3][2]), (None, 1, rows[4][2]), (10, None, rows[4][2])]
    rows += [(15, 1, None), (20, 2, [1.0, None]), (25, 2, [math.nan] * 20), (30, 0, [math.inf] * 20), (35, 2, []), (40, 1, [0.5, 0.25])]
    return rows + [(1000 + i, 2, rows[0][2]) for i in range(40)] + [(2000, 0, [0.0] * 20), (-5, 1, rows[9][2])]


def test_odd_rows(spark):
    assert found(given(spark, odd_rows()).selectExpr("*", "1 AS row", "2 AS scores")) == plain(odd_rows())


def test_small_tiles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(module, "ROW_TILE", 11)
    monkeypatch.setattr(module, "ANCHOR_TILE", 4)
    assert found(given(spark, odd_rows(seed=2))) == plain(odd_rows(seed=2))


def test_values_beyond_doubles(spark):
    rows = [(i, i % 2, [2.0**k * (1 + i / 16) for k in (40, 3, 0)]) for i in range(12)]
    rows += [(i, i % 2, [1.7e19, -3.0, float(i)]) for i in range(20, 24)] + [(30, 0, [1e307, 1.0])]
    assert found(given(spark, rows)) == plain(rows)


def test_empty(spark):
    assert found(given(spark, [])) == []
    assert found(given(spark, [(1, 0, [1.0])])) == []
    assert found(given(spark, [(0, 0, [1.0]), (5, 1, [1.0])])) == []


def test_bounds_drop_rows_and_keep_all_that_count():
    rng = np.random.default_rng(0)
    rows = np.floor(rng.normal(size=(4000, 64)) * np.linspace(200, 1, 64))
    tile, seen = module.Columns(rows), []

    def watch(settled):
        return lambda low, high: (seen.append(len(low)), settled(low, high))[1]

    for anchor in rows[:20]:
        at, score = tile.scan(anchor, np.arange(4000), watch(module.below_best(5)))
        full = rows @ anchor
        assert set(np.argsort(-full)[:5]) <= set(at) and (score == full[at]).all()
        top = int(np.sort(full)[-5])
        windows = module.windows_of([top])
        at, score = tile.scan(anchor, np.arange(4000), watch(module.outside(windows, 3)))
        inside = np.flatnonzero((full >= windows[0][1]) & (full <= windows[0][2]))
        assert set(inside[np.argsort(-full[inside])][:3]) <= set(at) and (score == full[at]).all()
    assert np.mean(seen) < 0.7 * 4000


def test_query(spark):
    got = QUERIES["op12_hard_negatives"](spark, SF).toPandas()
    assert len(got) and difference(got, connect(SF).sql(HARD_NEGATIVES_SQL).df()) is None


@pytest.mark.parametrize("scores, spans", [([100], [(100, 50, 95)]), ([0], [(0, 0, 0)]), ([-10], []), ([1], []), ([3, 3], [(3, 2, 2)])])
def test_windows(scores, spans):
    assert module.windows_of(scores) == spans
