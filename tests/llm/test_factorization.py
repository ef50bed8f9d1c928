from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from refload.llm import factorization as op
from tests.llm.conftest import SF


def test_query_on_held_out_rows(spark):
    from refload.llm.queries import QUERIES

    rows = {r["doc_id"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"]).to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    got = {r.doc_id: r for r in QUERIES["op6_factorization_machine"](spark, SF).collect()}
    assert set(got) == rows
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in labels if got[i].held_out]
    right = [got[i].predicted == labels[i] for i in held]
    good = [got[i].score for i in held if labels[i] == 1]
    bad = [got[i].score for i in held if labels[i] == 0]
    assert np.mean(right) >= 0.95 and np.mean([g > b for g in good for b in bad]) >= 0.97


def test_linear_time_sum_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = op.Machine(0.3)
    machine.w, machine.v = rng.normal(size=op.FEATURES), rng.normal(size=(op.FEATURES, op.RANK))
    for text in (b"a few words, of which a few are twice", b"", b"x" * 5000):
        at, x = op.features(text, 12)
        pairs = sum(machine.v[at[i]] @ machine.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
        want = 0.3 + machine.w[at] @ x + pairs
        assert np.isclose(machine.raw(at, x, np.array([0]))[0][0], want)


def test_pairs_are_learnt():
    """A label that hangs on two features together, and on neither alone."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 800), rng.integers(0, 2, 800)
    rows = [(np.array([i, 10 + j, 50]), np.ones(3)) for i, j in zip(a, b, strict=True)]
    machine = op.fit_machine(rows, (a == b).astype(float), epochs=60)
    raw, _ = machine.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.arange(800) * 3)
    assert ((raw > 0) == (a == b)).mean() > 0.95


def frame(spark, ids, texts, chars):
    return spark.createDataFrame(
        pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "n_chars": pa.array(chars, pa.int64())})
    )


def test_scores_hang_on_texts_alone_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    machine = op.train(docs, labels)
    again = op.train(docs.repartition(5).selectExpr("*", "1 AS text_crc32", "2 AS score", "3 AS label"), labels.repartition(3))
    assert np.array_equal(machine.w, again.w) and np.array_equal(machine.v, again.v)
    odd = frame(spark, [1, None, 2, 2, 3], ["", None, "one two", "one two", "x " * 200_000], [0, None, 7, 7, -1])
    got = op.score_quality(odd, machine).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 2}) == 1
    assert not next(r for r in got if r.doc_id is None).held_out
    kept = op.keep_predicted(odd, machine).collect()
    assert len(kept) == sum(r.predicted for r in got)
    assert op.score_quality(frame(spark, [], [], []), machine).collect() == []
    assert op.keep_predicted(frame(spark, [], [], []), machine).collect() == []


def test_few_or_no_labels(spark):
    docs = frame(spark, [3, 4, 5], ["a b", "c d", "e"], [3, 3, 1])
    for rows in ([], [(3, 1)], [(None, 1), (3, None), (4, 7)]):
        labels = spark.createDataFrame(
            pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "quality": pa.array([r[1] for r in rows], pa.int32())})
        )
        scores = {r.score for r in op.score_quality(docs, op.train(docs, labels)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1
