from __future__ import annotations

import re

import numpy as np
import pyarrow.parquet as pq

from refload.llm import curriculum as op
from tests.llm.conftest import SF


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes: dict) -> dict:
    """Excess over twice a source's size goes to the others by weight, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        heavy = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / heavy > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else left * weight[s] / heavy for s in names}
        full |= over


def check(got, rows):
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    targets = plain_targets(sizes)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r["doc_id"]), words(r["text"])) for r in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) <= 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r["size"]
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - targets[s]) <= 1


def test_query(spark):
    from refload.llm.queries import QUERIES

    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = QUERIES["op8_curriculum_mix"](spark, SF).collect()
    check(got, rows)
    assert sorted(map(str, got)) == sorted(map(str, QUERIES["op8_curriculum_mix"](spark, SF).repartition(3).collect()))


def test_levels():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.integers(0, 50, rng.integers(1, 9)).tolist()
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        want = list(plain_targets({f"{i:02}": s for i, s in enumerate(sizes)}).values())
        assert np.allclose(op.water_level(sizes, weights, 1.5, 2.0), want)


def test_positions_follow_the_schedule(spark):
    for ramp in (op.Ramp(0.5, 1.5), op.Ramp(1, 1), op.Ramp(1.5, 0.5), op.Ramp(0.001, 1)):
        from pyspark.sql import functions as F

        df = spark.range(1001).select((F.col("id") / 1000).alias("p"))
        got = df.select("p", op.due(F.col("p"), F.lit(float(ramp.start)), F.lit(float(ramp.end))).alias("t")).collect()
        for r in got:
            asked = (ramp.start * r.t + (ramp.end - ramp.start) * r.t**2 / 2) / ((ramp.start + ramp.end) / 2)
            assert abs(asked - r.p) < 1e-9


def test_mix(spark, documents):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i % 5 + 1)), f"s{i % 3}") for i in range(60)] + [(7, "w7_0 w7_1 w7_2", "s1")]
    docs = documents(rows)
    plan = op.curriculum(docs).collect()
    mixed = op.mix(docs)
    got = mixed.collect()
    assert mixed.columns == docs.columns
    assert sum(words(r.text) for r in got) == sum(r.taken for r in plan)
    assert len(got) == sum(len(r.passes) for r in plan)
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r.doc_id].startswith(r.text) for r in got)
    late = {r.doc_id: [p.position for p in r.passes] for r in plan}
    first = [min(late[r.doc_id]) for r in got]
    assert np.corrcoef(np.arange(len(first)), first)[0, 1] > 0.5


def test_odd_rows(spark, documents):
    rows = [(1, None, None), (1, "", "b"), (None, "one two", "é"), (2, "x " * 30_000, "a"), (2, "x " * 30_000, "a"), (3, "q", None)]
    docs = documents(rows).selectExpr("*", "'z' AS size", "0 AS rank", "1 AS id", "7 AS taken", "8 AS _p")
    check(op.curriculum(docs).collect(), [{"doc_id": i, "text": t, "source": s} for i, t, s in rows])
    got = op.mix(docs)
    assert got.columns == docs.columns and got.count() >= 3
    assert op.curriculum(documents([])).collect() == [] and op.mix(documents([])).collect() == []
    assert op.curriculum(documents([(1, " ", "a")])).select("target", "taken").collect() == [(0.0, 0)]


def test_passes_in_one_order(spark, documents):
    """Every pass has its rank and the words before it; a document without words has none."""
    rows = [(i, " ".join(["w"] * (i % 7)), f"s{i % 3}") for i in range(200)] + [(None, "a b c", "s0"), (None, "a b c", "s0"), (5, None, "s1")]
    made = op.in_order(op.curriculum(documents(rows))).collect()
    assert len(made) == len(rows) and all(r.taken == sum(p.words for p in r.passes) for r in made)
    passes = sorted((p.rank, p.position, p.words, p.start) for r in made for p in r.passes)
    assert [p[0] for p in passes] == list(range(len(passes)))
    assert [p[1] for p in passes] == sorted(p[1] for p in passes)
    total = 0
    for _, _, words, start in passes:
        assert start == total
        total += words
    assert op.in_order(op.curriculum(documents([]))).collect() == []


def test_mix_order_and_equal_rows(spark, documents):
    """Partition after partition, the mix is the plan's order; thousands of equal rows and nulls that trade places cost no pairs."""
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i % 5 + 1)), f"s{i % 3}") for i in range(300)]
    rows += [(None, "same words here", "s0")] * 3000
    docs = documents(rows).selectExpr("*", "if(doc_id % 2 = 0, 'u', null) AS _row", "if(doc_id % 2 = 0, null, 'u') AS _position", "map('k', doc_id) AS same")
    plan = op.in_order(op.curriculum(docs)).collect()
    want = sorted((p.position, p.words) for r in plan for p in r.passes)
    got = op.mix(docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert [words(r.text) for r in got] == [w for _, w in want]
    given = {r[0]: r for r in docs.collect()}
    assert all((r._row, r._position, r.same) == (given[r.doc_id]._row, given[r.doc_id]._position, given[r.doc_id].same) for r in got)
    assert sum(r.doc_id is None for r in got) == sum(len(r.passes) for r in plan if r.doc_id is None)


def test_mix_keeps_rows_apart_that_differ_by_where_a_null_is(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "x", None), (1, "a b", "s", None, "x")], "doc_id long, text string, source string, l string, r string")
    assert {(r.l, r.r) for r in op.mix(docs, share=2.0).collect()} == {("x", None), (None, "x")}
