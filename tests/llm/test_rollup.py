from __future__ import annotations

import base64
import re
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from refload.llm import rollup as op
from refload.session import new_folder
from tests.llm.conftest import SF


def events(spark, rows):
    names = ("id", "source", "lang", "version", "tokens", "deleted")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_())
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}))


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_query_against_plain_counts(spark):
    import public_tokenizers
    import tiktoken

    from refload.llm.queries import QUERIES, TOKENIZERS

    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want: dict = defaultdict(lambda: [0, 0])
    seen = set()
    for r in sorted(pq.read_table(f"{SF}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"]):
        if r["text"] in seen:
            continue
        seen.add(r["text"])
        counts = {"words": len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])), "byte_bpe_50k": len(coder.encode_ordinary(r["text"]))}
        for version, n in counts.items():
            want[r["source"], r["lang"], version][0] += 1
            want[r["source"], r["lang"], version][1] += n
    got = {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in QUERIES["op4_delta_rollup"](spark, SF).collect()}
    assert got == dict(want)


def test_inserts_revisions_moves_and_deletes(spark):
    rollup = op.TokenRollup(spark, new_folder(spark, "test-rollup"))
    assert totals(rollup) == {}
    first = events(spark, [(1, "a", "en", "v1", 10, False), (2, "a", "en", "v1", 5, False), (2, "a", "en", "v2", 6, False), (None, None, None, "v1", None, False)])
    assert rollup.commit("b1", first)
    start = {("a", "en", "v1"): (2, 15), ("a", "en", "v2"): (1, 6), (None, None, "v1"): (1, 0)}
    assert totals(rollup) == start
    assert not rollup.commit("b1", events(spark, [(9, "z", "en", "v1", 99, False)])) and totals(rollup) == start
    change = [(1, "b", "en", "v1", 11, False), (2, "a", "en", "v1", 5, True), (2, "a", "en", "v1", 4, False), (7, "a", "en", "v1", 1, True)]
    assert rollup.commit("b2", events(spark, change))
    after = {("b", "en", "v1"): (1, 11), ("a", "en", "v2"): (1, 6), (None, None, "v1"): (1, 0)}
    assert totals(rollup) == after
    assert rollup.commit("b3", events(spark, [(1, "b", "en", "v1", 11, False), (1, "b", "en", "v1", 11, False)])) and totals(rollup) == after
    assert rollup.commit("b4", events(spark, [(2, "a", "en", "v1", 8, False)]))
    assert totals(rollup) == after | {("a", "en", "v1"): (1, 8)}
    assert rollup.commit("b5", events(spark, [])) and rollup.batches() == ["b1", "b2", "b3", "b4", "b5"]
    current = {(r.id, r.version): r.tokens for r in rollup.current().collect()}
    assert current == {(1, "v1"): 11, (2, "v1"): 8, (2, "v2"): 6, (None, "v1"): 0}


def test_a_batch_that_failed_half_way_is_written_over(spark):
    root = new_folder(spark, "test-rollup")
    rollup = op.TokenRollup(spark, root)
    rollup.commit("b1", events(spark, [(1, "a", "en", "v1", 10, False)]))
    wrong = events(spark, [(5, "a", "en", "v1", 1000, False)]).selectExpr("id", "version", "source", "lang", "1L AS docs", "tokens")
    wrong.write.parquet(f"{root}/ledger/b2")
    assert totals(rollup) == {("a", "en", "v1"): (1, 10)}
    assert op.TokenRollup(spark, root).commit("b2", events(spark, [(1, "a", "en", "v1", 12, False)]))
    assert totals(rollup) == {("a", "en", "v1"): (1, 12)}
    with pytest.raises(ValueError, match="bad batch name"):
        rollup.commit("b/3", wrong)


def test_odd_texts(spark, documents):
    from refload.llm.queries import TOKENIZERS

    rows = [(1, None, None), (1, "", "b"), (None, "one two", "é"), (2, "word " * 50_000, "a"), (2, "word " * 50_000, "a")]
    docs = documents(rows).selectExpr("*", "1 AS id", "2 AS tokens", "3 AS words", "4 AS print")
    got = op.corpus_rollup(docs, new_folder(spark, "test-rollup"), TOKENIZERS).collect()
    assert sum(r.tokens for r in got if r.version == "words") == 50_002
    assert op.corpus_rollup(documents([]), new_folder(spark, "test-rollup"), TOKENIZERS).collect() == []


def test_every_row_counts(spark, documents):
    rows = [(None, "one two"), (None, "one two"), (None, "three"), (4, "four five six"), (4, "other"), (4, "other"), (9, "other"), (9, None)]
    from refload.llm.queries import TOKENIZERS

    got = op.corpus_rollup(documents(rows), new_folder(spark, "test-rollup"), TOKENIZERS).collect()
    assert {(r.docs, r.tokens) for r in got if r.version == "words"} == {(6, 2 + 2 + 1 + 3 + 1 + 0)}
    assert [r.docs for r in got] == [6, 6]


def test_small_batches_read_their_buckets_and_compaction_changes_no_total(spark):
    root = new_folder(spark, "test-rollup")
    rollup = op.TokenRollup(spark, root, buckets=16)
    assert not rollup.compact()
    first = [(i, f"s{i % 3}", "en", "v1", i, False) for i in range(200)] + [(None, "s0", None, None, 5, False)]
    assert rollup.commit("b1", events(spark, first))
    assert op.TokenRollup(spark, root, buckets=99).buckets == 16
    one = op.materialize(rollup._bucketed(events(spark, [(7, "s1", "en", "v1", 9, False)])), "test-one")
    assert [(r.id, r.tokens) for r in rollup.current(one).collect()] == [(7, 7)]
    read = {p.split("bucket=")[1].split("/")[0] for p in rollup._committed("ledger").where(F.col("bucket") == one.first().bucket).inputFiles()}
    assert read and one.first().bucket in map(int, read)
    assert rollup.commit("b2", events(spark, [(7, "s1", "en", "v1", 9, False), (8, "s2", "en", "v1", 0, True), (None, "s0", None, None, None, False)]))
    before = totals(rollup)
    assert rollup.compact() and not rollup.compact() and totals(rollup) == before
    assert rollup.batches() == ["b1", "b2"] and not rollup.commit("b2", events(spark, [(1, "z", "z", "z", 1, False)]))
    assert rollup.commit("b3", events(spark, [(7, "s0", "en", "v1", 1, False)]))
    assert rollup.compact() and rollup.current().count() == 200
    want: dict = defaultdict(lambda: [0, 0])
    for i, s, lang, v, n, _ in first:
        s, n = {7: ("s0", 1), None: ("s0", 0)}.get(i, (s, n))
        if i != 8:
            want[s, lang, v][0] += 1
            want[s, lang, v][1] += n
    assert totals(rollup) == {k: tuple(x) for k, x in want.items()}
