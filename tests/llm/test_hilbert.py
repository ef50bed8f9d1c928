from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from refload.llm import hilbert as op
from tests.llm.conftest import SF


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2), (1, 4)])
def test_curve_steps_to_a_neighbour(dims, bits):
    points = np.array(list(itertools.product(range(2**bits), repeat=dims)))
    place = op.curve_index(points, bits)
    assert sorted(place.tolist()) == list(range(2 ** (bits * dims)))
    walk = points[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check_rows(got, rows, shards):
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = {s: sorted(r.slot for r in got if r["shard"] == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in slots.values())
    ordered = sorted(got, key=lambda r: (r["shard"], r.slot))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in got)
    return [len(v) for v in slots.values()]


def test_query(spark):
    from refload.llm.queries import QUERIES

    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = QUERIES["op3_hilbert_shards"](spark, SF).collect()
    counts = check_rows(got, [(r["doc_id"], r["text"]) for r in rows], 16)
    assert max(counts) - min(counts) <= 1 and {r.law for r in got} == {"rows"}


def test_bytes_law_and_boxes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dealt = op.hilbert_shards(docs, ["source", "lang", "n_chars"], 8, "bytes")
    got = dealt.collect()
    assert {r["shard"] for r in got} == set(range(8))
    total = sum(r["size"] for r in got)
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(abs(x - total / 8) for x in loads) <= max(r["size"] for r in got)
    boxes = op.shard_boxes(docs, dealt, ["lang", "n_chars"]).collect()
    hit = sum(b.min_lang <= "fr" <= b.max_lang and b.min_n_chars <= 300 for b in boxes)
    assert len(boxes) == 8 and hit < 8


def test_written_shards(spark, documents, tmp_path):
    docs = documents([(i, "w " * (i % 7)) for i in range(50)])
    dealt = op.hilbert_shards(docs, ["n_chars"], 5)
    op.write_shards(docs, dealt, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 5


def test_odd_rows(spark, documents):
    rows = [(1, None, None), (1, "", "b"), (None, "ü", "é"), (2, "x" * 200_000, "a"), (2, "x" * 200_000, "a"), (3, "q", None)]
    docs = documents(rows).selectExpr("*", "'z' AS size", "0 AS curve", "1 AS id", "7 AS code0")
    for law in ("rows", "bytes"):
        check_rows(op.hilbert_shards(docs, ["source", "lang", "n_chars"], 4, law).collect(), [r[:2] for r in rows], 4)
    assert op.hilbert_shards(documents([]), ["source"], 4).collect() == []
    with pytest.raises(ValueError, match="unknown law"):
        op.hilbert_shards(docs, ["source"], 4, "other")


def test_strings_alike_at_their_start_are_told_apart(spark):
    """Ten sources with a long common beginning as the only dimension: a shard holds a run of them, not all."""
    rows = [(i, f"text {i}", f"common_crawl_{i % 10}" if i % 50 else None) for i in range(1600)]
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": pa.array([r[2] for r in rows], pa.string())})
    docs = spark.createDataFrame(table)
    dealt = op.hilbert_shards(docs, ["source"], 16, "rows")
    held: dict[int, set] = {}
    for r in docs.join(dealt.select("doc_id", "shard"), "doc_id").collect():
        held.setdefault(r.shard, set()).add(r.source)
    assert len(held) == 16 and max(map(len, held.values())) <= 3
    whole = op.value_ranks(docs, "source").orderBy("value").collect()
    assert [r.rank for r in whole] == [float(i) for i in range(10)]
