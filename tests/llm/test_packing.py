from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from refload.llm import packing as op
from tests.llm.conftest import SF


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(got, rows, capacities):
    sizes = defaultdict(list)
    for i, t in rows:
        sizes[i].append(words(t))
    found = defaultdict(int)
    bins = defaultdict(list)
    for r in got:
        found[r.doc_id] += r.n_words
        assert r.from_word == r.piece * max(capacities)
        if r.n_words:
            bins[r.bin_id].append((r.offset, r.n_words, r.capacity))
        else:
            assert r.bin_id is None and r.capacity is None
    assert dict(found) == {i: sum(v) for i, v in sizes.items()}
    for parts in bins.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert {c for _, _, c in parts} == {min(c for c in capacities if c >= at)}
    return sum(r.n_words for r in got) / max(1, sum(p[0][2] for p in bins.values()))


def test_query(spark):
    from refload.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = QUERIES["op7_best_fit_packing"](spark, SF).collect()
    assert check(got, rows, op.CAPACITIES) > 0.97
    again = QUERIES["op7_best_fit_packing"](spark, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_holds(lengths):
    sizes = (8, 16, 64)
    bins, offsets, capacities = op.best_fit(lengths, sizes)
    for b, c in enumerate(capacities):
        mine = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        end = 0
        for offset, n in mine:
            assert offset == end
            end += n
        assert c == min(s for s in sizes if s >= end)


def test_joint_sizes_beat_any_single_one():
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.lognormal(5.5, 1.2, 3000).astype(int) + 1, 4096).tolist()
    cost = [sum(map(op.sequence_cost, op.best_fit(lengths, s)[2])) for s in (op.CAPACITIES, (4096,))]
    assert cost[0] < cost[1]
    assert sum(lengths) / sum(op.best_fit(lengths)[2]) > 0.98


def test_least_cost_size_is_opened():
    assert op.best_fit([300], (512, 4096))[2] == [512]
    assert op.expected_fill(100, [10, 40, 70], 3) == 80
    assert op.best_fit([500, 500, 500], (512, 1024), lambda c: c)[2] in ([512] * 3, [1024, 512])


def test_odd_rows_and_groups(spark, documents):
    rows = [(1, None), (1, ""), (None, "one two"), (2, "x " * 9000), (2, "x " * 9000), (3, "q"), (4, "w " * 4096)]
    docs = documents(rows).selectExpr("*", "'z' AS rank", "0 AS piece", "1 AS id", "7 AS part", "8 AS size")
    check(op.pack(docs).collect(), rows, op.CAPACITIES)
    assert op.pack(documents([])).collect() == []
    many = [(i, "w " * (i % 50)) for i in range(500)]
    check(op.pack(documents(many), (16, 32, 64), group=37).collect(), many, (16, 32, 64))


def least_cost(lengths, sizes):
    """Cost of the best packing: every set of items is tried as the bin of its first item."""
    n = len(lengths)
    total = [sum(lengths[i] for i in range(n) if m >> i & 1) for m in range(1 << n)]
    price = [min((op.sequence_cost(c) for c in sizes if c >= t), default=float("inf")) for t in total]
    best = [0.0] * (1 << n)
    for m in range(1, 1 << n):
        low, rest = m & -m, m & (m - 1)
        part, best[m] = rest, float("inf")
        while True:
            best[m] = min(best[m], price[part | low] + best[rest ^ part])
            if not part:
                break
            part = (part - 1) & rest
    return best[-1]


def test_cost_against_all_assignments():
    """Up to eight items: never below the least cost of all assignments and sizes, close to it on the whole."""
    rng = np.random.default_rng(5)
    ratios = []
    for _ in range(150):
        lengths = np.minimum(rng.lognormal(6, 1.2, int(rng.integers(1, 9))).astype(int) + 1, 4096).tolist()
        least = least_cost(lengths, op.CAPACITIES)
        ratios.append(sum(map(op.sequence_cost, op.best_fit(lengths)[2])) / least)
    assert min(ratios) > 1 - 1e-9
    assert max(ratios) <= 1.5 and np.mean(ratios) <= 1.05, (max(ratios), np.mean(ratios))
