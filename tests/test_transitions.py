"""Workflows as state machines: refused requests, milestones, timeouts by timer, newest changes."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from refload.session import local_rows, new_folder
from refload.streaming.events import EVENTS
from refload.streaming.transitions import REFUSED, recheck_stream, record_transitions, transition_stream
from tests.test_readiness import drain, rocksdb  # noqa: F401

START = datetime(2024, 1, 31, 12, 0)
SCHEMA = "workflow_id string, seq long, at timestamp, status string"


def requests(spark, folder, rows):
    made = [(w, n, START + timedelta(minutes=m), s) for w, n, m, s in rows]
    local_rows(spark, made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).parquet(folder)


def told(df):
    minute = ((F.unix_timestamp("at") - int((START - datetime(1970, 1, 1)).total_seconds())) / 60).cast("int")
    return sorted(map(tuple, df.select("workflow_id", "seq", minute.alias("m"), "status", "previous", "accepted").collect()), key=str)


def run(spark, batches, **options):
    folder, out, checkpoint = (new_folder(spark, x) for x in ("requests", "told", "machine"))
    for rows in batches:
        drain(transition_stream(requests(spark, folder, rows), **options), out, checkpoint)
    return spark.read.parquet(out), checkpoint


@pytest.mark.usefixtures("rocksdb")
def test_every_request_comes_out_and_times_are_kept(spark):
    batches = [
        [("w", 2, 2, "shipped"), ("w", 1, 1, "pending_excel"), ("w", 3, 3, "excel_generated"), ("v", 1, 1, None)],
        [("w", 4, 4, "approved"), ("w", 5, 5, "processing")],
        [("w", 6, 6, "completed"), ("w", 6, 6, "")],
    ]
    found, _ = run(spark, batches)
    assert told(found) == sorted(
        [
            ("w", 1, 1, "pending_excel", "", True), ("w", 2, 2, "shipped", "pending_excel", False), ("w", 3, 3, "excel_generated", "pending_excel", True),
            ("w", 4, 4, "approved", "excel_generated", True), ("w", 5, 5, "processing", "approved", True), ("w", 6, 6, "completed", "processing", True),
            ("w", 6, 6, "", "completed", False), ("v", 1, 1, None, "", False),
        ],
        key=str,
    )
    last = found.where("status = 'completed'").first()
    assert [last[c] - START for c in ("created_at", "excel_generated_at", "approved_at", "completed_at")] == [timedelta(minutes=m) for m in (1, 3, 4, 6)]
    assert {r.reason for r in found.where("NOT accepted").collect()} == {f"Invalid workflow status: {s}" for s in ("shipped", "", None)}


@pytest.mark.usefixtures("rocksdb")
def test_a_timer_ends_long_processing(spark):
    """w runs into the limit when others move the clock; v is done in time; u comes too late, in the same batch."""
    batches = [
        [("w", 1, 0, "processing"), ("v", 1, 0, "processing"), ("u", 1, 0, "processing"), ("u", 2, 125, "completed")],
        [("v", 2, 119, "completed"), ("x", 1, 119, "approved")],
        [("x", 2, 140, "approved")],
        [("x", 3, 141, "approved")],
    ]
    found, checkpoint = run(spark, batches, late="10 minutes")
    errors = [t for t in told(found) if t[3] == "error"]
    assert errors == [("u", 1, 120, "error", "processing", True), ("w", 1, 120, "error", "processing", True)]
    assert ("u", 2, 125, "completed", "error", True) in told(found)
    assert {r.reason for r in found.where("status = 'error'").collect()} == {"Processing timeout after 2:00:00"}
    assert spark.read.format("statestore").option("readRegisteredTimers", True).load(checkpoint).count() == 0


@pytest.mark.usefixtures("rocksdb")
def test_the_clock_of_the_machine(spark):
    folder, out = new_folder(spark, "requests"), new_folder(spark, "told")
    stream = transition_stream(requests(spark, folder, [("w", 1, 0, "processing")]), stuck_hours=2 / 3600, machine_clock=True)
    query = stream.writeStream.format("parquet").option("checkpointLocation", new_folder(spark, "machine")).trigger(processingTime="1 second").start(out)
    try:
        for _ in range(60):
            time.sleep(1)
            if query.lastProgress and spark.read.schema(stream.schema).parquet(out).where("status = 'error'").count():
                break
    finally:
        query.stop()
    assert sorted(r.status for r in spark.read.schema(stream.schema).parquet(out).collect()) == ["error", "processing"]


@pytest.mark.usefixtures("rocksdb")
def test_accepted_and_refused_go_to_tables_of_their_own(spark, warehouse):
    folder = new_folder(spark, "requests")
    for _ in range(2):  # the second time from nothing: rows already there are not written again
        stream = requests(spark, folder, [("w", 1, 1, "approved"), ("w", 2, 2, "nowhere")])
        record_transitions(warehouse, transition_stream(stream), new_folder(spark, "record"), once=True).awaitTermination()
    assert [(r.workflow_id, r.status, r.error_message) for r in warehouse.table(warehouse.main(EVENTS)).collect()] == [("w", "approved", None)]
    refused = warehouse.table(warehouse.main(REFUSED)).collect()
    assert [(r.workflow_id, r.status, r.error_message) for r in refused] == [("w", "nowhere", "Invalid workflow status: nowhere")]


def test_the_newest_change_wins_over_batches(spark):
    flows = local_rows(spark, [("a", "pending_excel"), ("b", "pending_excel"), ("c", "completed")], "workflow_id string, status string")
    schema = "workflow_id string, ready boolean, at timestamp, seq long"
    folder, path, checkpoint = (new_folder(spark, x) for x in ("changes", "rechecked", "recheck"))
    batches = [
        [("a", True, 5, 1), ("a", False, 4, 9), ("b", True, 1, 1), ("c", True, 1, 1)],
        [("b", False, 2, 1), ("a", False, 3, 1)],
    ]
    seen = []
    for rows in batches:
        made = [(w, r, START + timedelta(minutes=m), s) for w, r, m, s in rows]
        local_rows(spark, made, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        recheck_stream(stream, lambda: flows, path, checkpoint, once=True).awaitTermination()
        last = spark.read.parquet(path).groupBy("workflow_id").agg(F.max_by("status", "batch").alias("s"))
        seen.append(sorted((r.workflow_id, r.s) for r in last.collect()))
    assert seen == [[("a", "excel_generated"), ("b", "excel_generated")], [("a", "excel_generated"), ("b", "pending_excel")]]
