from __future__ import annotations

import math
import re
from collections import defaultdict

import pyarrow.parquet as pq

import corpus_pipeline
from refload.llm import factorization
from refload.llm.packing import CAPACITIES
from refload.llm.perplexity import quality_rules
from refload.session import materialize
from tests.llm import test_packing
from tests.llm.test_curriculum import plain_targets
from tests.llm.test_simhash import plain_classes, plain_print

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        made.append(docs)
    assert all(d.columns == COLUMNS for d in made[:-1])
    ruled, sorted_out, unique, mixed = ({r.doc_id: r for r in d.collect()} for d in made[:4])
    given = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert set(ruled) == {r.doc_id for r in quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}

    machine = factorization.train(made[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = machine.score([r.text.encode() for r in ruled.values()], [r.n_chars for r in ruled.values()])
    assert set(sorted_out) == {i for i, s in zip(ruled, scores, strict=True) if s >= 0.5}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    good = [i for i in labels if labels[i] == 1 and len(words(given[i]["text"])) >= 20]
    assert len(set(good) & set(sorted_out)) > 0.97 * len(good)
    assert not [i for i in sorted_out if labels.get(i) == 0]

    classes = plain_classes({i: plain_print(r.text) for i, r in sorted_out.items()})
    assert set(unique) == set(classes.values())

    sizes = defaultdict(int)
    for r in unique.values():
        sizes[r.source] += len(words(r.text))
    taken = defaultdict(int)
    for r in made[3].collect():
        assert words(r.text) == words(unique[r.doc_id].text)[: len(words(r.text))]
        assert r.n_chars == len(r.text)
        taken[r.source] += len(words(r.text))
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= 1
    rows = [(r.doc_id, r.text) for r in made[3].collect()]
    assert test_packing.check(made[4].collect(), rows, CAPACITIES) > 0.95
    assert set(mixed) <= set(unique)


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF.replace("0.01", "0.001"))
    assert {"doc_id", "bin_id", "offset", "capacity"} <= set(got.columns)
    assert math.isclose(got.count(), got.filter("n_words > 0").count())


def test_empty_corpus(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
