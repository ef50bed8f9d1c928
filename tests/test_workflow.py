"""Workflow questions, stability with hot files, streams."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from refload.operators.ordered import stable_files
from refload.operators.validate import foreign_key, unique_key, validate_stage
from refload.operators.workflow import (
    canonical_load_config,
    current_workflows,
    retry_failed,
    timeout_stuck,
    validate_load_config,
)
from refload.session import new_folder
from refload.sources.inventory import admit_files, size_mb
from refload.streaming.ingest import run_to_folder
from refload.streaming.stability import stream_stability

START = datetime(2024, 1, 1)


def scans_with_a_hot_file():
    """Half of all scans are of one file, over many chunks, with long quiet runs."""
    random.seed(3)
    scans, number = [], 0
    for path, count in (("hot", 600), ("a", 150), ("b", 150), ("once", 1)):
        size = 0
        for i in range(count):
            number += 1
            size += random.random() < 0.08
            scans.append((path, START + timedelta(minutes=7 * i), number, size, size // 2))
    return scans


def counted_one_by_one(scans):
    seen, counts = {}, {}
    for path, _, number, size, mtime in sorted(scans, key=lambda s: (s[1], s[2])):
        before = seen.get(path)
        count = before[2] + 1 if before and before[:2] == (size, mtime) else 1
        seen[path] = (size, mtime, count)
        counts[number] = count
    return counts


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_stable_files_for_any_chunk(spark, unit):
    scans = scans_with_a_hot_file()
    table = spark.createDataFrame(scans, "path string, ts timestamp_ntz, n int, size int, mtime int")
    found = stable_files(table, "path", ["ts", "n"], ["size", "mtime"], F.date_trunc(unit, "ts"), needed=6)
    rows = found.collect()
    assert {r.n: r.stable_count for r in rows} == counted_one_by_one(scans)
    assert all(r.is_stable == (r.stable_count >= 6) for r in rows)


def test_stability_stream_over_several_batches(spark):
    scans = scans_with_a_hot_file()[:400]
    folder = new_folder(spark, "scans")
    for part in range(4):
        rows = [(s[0], s[2], float(s[3]), s[4]) for s in scans[part * 100 : part * 100 + 100]]
        spark.createDataFrame(rows, "path string, scan_id long, size double, mtime long").coalesce(1).write.mode("append").json(folder)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    try:
        stream = spark.readStream.schema("path string, scan_id long, size double, mtime long").option("maxFilesPerTrigger", 1).json(folder)
        out = new_folder(spark, "counts")
        run_to_folder(stream_stability(stream, idle_ms=None), out, new_folder(spark, "checkpoint"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {r.scan_id: r.stable_count for r in spark.read.parquet(out).collect()}
    assert got == counted_one_by_one(scans)


def events(spark, rows):
    schema = (
        "workflow_id string, seq int, at timestamp_ntz, status string, error_message string, file_path string,"
        "user_config string, processed_by string, retry_count int, payload string"
    )
    full = [(w, i, START + timedelta(hours=h), s, e, "f", None, None, r, None) for i, (w, h, s, e, r) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def test_states_timeouts_and_retries(spark):
    state = current_workflows(
        events(
            spark,
            [
                ("done", 0, "pending_excel", None, None),
                ("done", 1, "excel_generated", None, None),
                ("done", 2, "approved", None, None),
                ("done", 3, "completed", None, None),
                ("stuck", 0, "processing", None, None),
                ("busy", 4, "processing", None, None),
                ("failed", 1, "error", "boom", 2),
                ("spent", 1, "error", "boom", 3),
                ("again", 1, "error", "boom", 1),
                ("again", 2, "pending_excel", None, 2),
            ],
        )
    ).cache()
    rows = {r.workflow_id: r for r in state.collect()}
    assert rows["done"].completed_at == START + timedelta(hours=3)
    assert rows["done"].excel_generated_at == START + timedelta(hours=1)
    assert (rows["again"].status, rows["again"].error_message, rows["again"].retry_count) == ("pending_excel", None, 2)
    assert rows["failed"].error_message == "boom"
    now = START + timedelta(hours=5)
    assert [r.workflow_id for r in timeout_stuck(state, now).collect()] == ["stuck"]
    assert [(r.workflow_id, r.retry_count) for r in retry_failed(state, now).collect()] == [("failed", 3)]


FORM = dict(
    delimiter="Tab", text_qualifier="None", encoding="UTF-8", processing_mode="append", table_name="t1",
    processed_by="me", process_date=None, has_headers="Yes", is_reference_data="Yes", confirmed="Yes",
)


@pytest.mark.parametrize(
    ("change", "errors"),
    [
        ({}, 0),
        ({"confirmed": "No"}, 1),
        ({"processed_by": None}, 1),
        ({"delimiter": "#"}, 1),
        ({"encoding": "latin-9"}, 1),
        ({"processing_mode": "Select Mode"}, 2),
        ({"table_name": "1t"}, 1),
        ({"table_name": None}, 1),
        ({"table_name": None, "is_reference_data": "No"}, 0),
    ],
)
def test_load_settings(spark, change, errors):
    form = {**FORM, **change}
    table = spark.createDataFrame([tuple(form.values())], ", ".join(f"{k} string" for k in form))
    row = validate_load_config(canonical_load_config(table)).first()
    assert (len(row.errors), row.valid) == (errors, errors == 0)
    if not change:
        assert (row.delimiter, row.text_qualifier, row.process_date) == ("\t", "", "")


def test_keys_with_a_hot_value(spark):
    rows = spark.range(900).select(F.when(F.col("id") < 600, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    parents = spark.range(600, 880).toDF("p")
    issues = validate_stage(rows, [unique_key(1, "k"), foreign_key(2, "k", parents, "p")])
    assert {r.issue_id: r.rows for r in issues.collect()} == {1: 599, 2: 620}


def test_file_admission(spark):
    files = spark.createDataFrame([("a.csv", 10), ("b.CSV", 21 * 2**20), ("c.txt", 0)], "filename string, size_bytes long")
    rows = {r.filename: r for r in admit_files(files.withColumn("size_mb", size_mb(F.col("size_bytes")))).collect()}
    assert rows["a.csv"].valid and rows["a.csv"].size_mb == 0.01
    assert rows["b.CSV"].errors == ["File size (21.0 MB) exceeds maximum limit (20.0 MB)"]
    assert rows["c.txt"].errors == ["File must have .csv extension"] and rows["c.txt"].size_mb == 0.0
