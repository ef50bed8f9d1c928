"""Looks at a folder, the wait until files are ready, and the formats their loads take."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from refload.operators.workflow import current_workflows
from refload.session import local_rows, new_folder
from refload.sources.delimited import DelimitedFormat
from refload.sources.descriptors import DESCRIPTORS, newest_descriptors, parse_descriptor
from refload.sources.listing import folder_looks, listed
from refload.streaming import ingest
from refload.streaming.events import EVENT_SCHEMA, EVENTS, append_events
from refload.streaming.readiness import full_events, profile_ready, ready_files, watch_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime(2024, 1, 31, 12, 0)
LOOK_SCHEMA = "path string, size long, mtime long, scan_id long, looked_at timestamp, gone boolean"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    yield
    spark.conf.set(key, before)


def drain(stream, path, checkpoint):
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def test_looks_show_what_grew_came_again_and_went(spark, tmp_path):
    folder, log = tmp_path / "in", new_folder(spark, "looks")
    out, checkpoint = new_folder(spark, "looks-out"), new_folder(spark, "looks-checkpoint")
    folder.mkdir()

    def look():
        drain(folder_looks(spark, os.fspath(folder), log), out, checkpoint)  # a new query each time: a restart

    look()
    (folder / "a.csv").write_text("id\n1\n")
    (folder / "other.txt").write_text("no")
    look()
    (folder / "a.csv").write_text("id\n1\n2\n")
    (folder / "empty.csv").write_text("")
    look()
    (folder / "a.csv").unlink()
    look()
    os.utime(folder / "empty.csv", (1_700_000_000, 1_700_000_000))
    (folder / "a.csv").write_text("id\n9\n")
    look()
    rows = spark.read.parquet(out).select("scan_id", F.substring_index("path", "/", -1), "size", "gone").collect()
    assert sorted(map(tuple, rows)) == [
        (2, "a.csv", 5, False), (3, "a.csv", 7, False), (3, "empty.csv", 0, False), (4, "a.csv", 7, True), (4, "empty.csv", 0, False),
        (5, "a.csv", 5, False), (5, "empty.csv", 0, False),
    ]
    assert listed(os.fspath(tmp_path / "nowhere"), "*") == {}
    assert len([f for f in os.listdir(log) if f.endswith(".json")]) <= 2  # looks that are done with are gone


def looks_of(spark, rows):
    """(path, minute, size[, gone]) rows."""
    made = [(p, s, s * 10, m, (START + timedelta(minutes=m)).isoformat(" "), bool(gone)) for p, m, s, *gone in rows]
    return local_rows(spark, made, LOOK_SCHEMA.replace("timestamp", "string")).withColumn("looked_at", F.col("looked_at").cast("timestamp"))


def gate(spark, batches, events=(), wanted=3, idle_ms=3_600_000):
    """Ready rows of looks, one stored file and so one micro-batch each; events (path, minute, status) come with the batch of their number."""
    folder, told = new_folder(spark, "gate-looks"), new_folder(spark, "gate-events")
    out, checkpoint = new_folder(spark, "gate-out"), new_folder(spark, "gate-checkpoint")
    for k, rows in enumerate(batches):
        looks_of(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        made = [("w", s, (START + timedelta(minutes=m)).isoformat(" "), m, None, 0, p, None, None) for at, p, m, s in events if at == k]
        local_rows(spark, made, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(told)
        stream = ready_files(
            spark.readStream.schema(LOOK_SCHEMA).parquet(folder),
            spark.readStream.schema(EVENT_SCHEMA).parquet(told), wanted, idle_ms,
        )
        drain(stream, out, checkpoint)
    return sorted(map(tuple, spark.read.parquet(out).select("path", "scan_id", "size", "looks").collect())), (folder, told, checkpoint)


def state_rows(spark, checkpoint):
    return spark.read.format("statestore").option("stateVarName", "file").load(checkpoint).count()


def test_a_file_is_ready_after_equal_looks_only(spark, rocksdb):
    batches = [
        [("/in/a", 1, 5), ("/in/b", 1, 5), ("file:///in/a", 2, 5)],
        [("/in/a", 3, 5), ("/in/b", 2, 6), ("/in/b", 3, 6)],
        [("/in/a", 4, 7), ("/in/b", 4, 6), ("/in/b", 5, 6)],
    ]
    found, _ = gate(spark, batches)
    assert found == [("/in/a", 3, 5, 3), ("/in/b", 4, 6, 3), ("/in/b", 5, 6, 4)]


def test_a_file_that_went_or_has_a_workflow_is_forgotten(spark, rocksdb):
    batches = [
        [("/in/a", 1, 5), ("/in/a", 2, 5), ("/in/b", 1, 5), ("/in/b", 2, 5)],
        [("/in/a", 3, 5, True), ("/in/b", 4, 5)],
        [("/in/a", 5, 5), ("/in/a", 6, 5), ("/in/b", 5, 5), ("/in/b", 6, 5), ("/in/b", 8, 5), ("/in/b", 9, 5)],
    ]
    events = [(1, "/in/b", 3, "excel_generated"), (2, "/in/b", 7, "completed")]
    found, (_, _, checkpoint) = gate(spark, batches, events)
    assert found == []
    assert state_rows(spark, checkpoint) == 2
    batches.append([("/in/b", 10, 5), ("/in/a", 7, 5, True)])
    found, (_, _, checkpoint) = gate(spark, batches, events)
    assert found == [("/in/b", 10, 5, 3)]
    assert state_rows(spark, checkpoint) == 1


def test_a_timer_forgets_idle_files(spark, rocksdb):
    """The clock is the time of the looks: other files move it on."""
    batches = [[("/in/a", 1, 5), ("/in/a", 2, 5)], [("/in/b", 100, 1)], [("/in/b", 101, 1)], [("/in/a", 102, 5), ("/in/b", 180, 2)]]
    found, (_, _, checkpoint) = gate(spark, batches, idle_ms=30 * 60_000)
    assert found == []  # without the timer the third equal look at a would have made it ready
    found, _ = gate(spark, batches, idle_ms=200 * 60_000)
    assert found == [("/in/a", 102, 5, 3)]


def test_ready_files_are_profiled_once_and_open_a_workflow(spark, warehouse, tmp_path, rocksdb):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "a.csv").write_text("id;v\n1;x\n2;y\n")
    registry, log, checkpoint = new_folder(spark, "registry"), new_folder(spark, "looks"), new_folder(spark, "watch")

    def look(times=1):
        for _ in range(times):
            looks = folder_looks(spark, os.fspath(folder), log)
            events = None
            if warehouse.exists(warehouse.main(EVENTS)):
                events = spark.readStream.table(warehouse.main(EVENTS))
            watch_folder(warehouse, looks, registry, checkpoint, events, once=True, wanted=2).awaitTermination()

    append_events(warehouse, local_rows(spark, [], EVENT_SCHEMA))
    look(1)
    assert not os.path.exists(registry)
    look(3)
    found = spark.read.parquet(registry).collect()
    assert [(r.path.rsplit("/", 1)[1], r.column_delimiter) for r in found] == [("a.csv", ";")]
    flows = current_workflows(full_events(warehouse)).collect()
    assert [(r.status, r.file_path) for r in flows] == [("excel_generated", os.fspath(folder / "a.csv"))]
    described = parse_descriptor(F.col("document"))
    documents = lambda: newest_descriptors(warehouse.table(warehouse.main(DESCRIPTORS))).select(described.alias("d")).collect()
    assert [(r.d.csv_format.column_delimiter, r.d.inferred_schema) for r in documents()] == [(";", None)]
    path = os.fspath(folder / "a.csv")
    ingest.load_approved(warehouse, approve(spark, (flows[0].workflow_id, path, "items", None, "2024-01-31 12:00:00", None)), 0, registry)
    assert [r.d.inferred_schema for r in documents()] == [{"id": "varchar(1024)", "v": "varchar(1024)"}]
    ready = local_rows(spark, [(os.fspath(folder / "a.csv"), 14, 0, 9, 6)], "path string, size long, mtime long, scan_id long, looks long")
    append_events(warehouse, local_rows(spark, [("w9", "approved", "2999-01-01", 1, None, 0, path, None, None)], EVENT_SCHEMA))
    profile_ready(warehouse, ready, 99, registry)  # asked for again while a workflow is open
    assert spark.read.parquet(registry).count() == 1


PROFILES = (
    "path string, modificationTime timestamp, column_delimiter string, text_qualifier string, encoding string, has_header boolean, "
    "has_trailer boolean, skip_lines int, error string"
)


def profile(path, at, delimiter, error=None):
    return (path, datetime.fromisoformat(at), delimiter, '"', "utf-8", True, False, 0, error)


def approve(spark, *rows):
    """(workflow, path, base, delimiter, load_time, approved_at, other fields)."""
    made = []
    for w, path, base, delimiter, at, approved, *rest in rows:
        person, schema = (*rest, None, None)[:2]
        until = datetime.fromisoformat(approved) if approved else None
        made.append((w, path, base, delimiter, "append", at, None, None, None, None, None, person, schema, until))
    return local_rows(spark, made, ingest.APPROVAL_SCHEMA)


def test_the_newest_profile_before_the_approval_counts(spark):
    """A file that is dropped again is profiled again; the largest delimiter is not the newest."""
    formats = local_rows(
        spark,
        [
            profile("file:///in/a.csv", "2024-01-05", "|"), profile("file:/in/a.csv", "2024-02-05", ","), profile("/in/a.csv", "2024-03-05", ";"),
            profile("/in/a.csv", "2024-03-06", "\t", "broken"), profile("/in/b.csv", "2024-03-05", ";"),
        ],
        PROFILES,
    )
    asked = [
        ("w1", "/in/a.csv", "x", None, "t", "2024-01-31"), ("w2", "/in/a.csv", "x", None, "t", "2024-02-28"), ("w3", "/in/a.csv", "x", None, "t", None),
        ("w4", "/in/a.csv", "x", None, "t", "2024-01-01"), ("w5", "/in/a.csv", "x", ":", "t", "2024-02-28"), ("w6", "/in/c.csv", "x", None, "t", None),
    ]
    found = ingest.with_formats(approve(spark, *asked), formats).orderBy("workflow_id").select("_column_delimiter", "_known").collect()
    assert [tuple(r) for r in found] == [("|", True), (",", True), (";", True), (",", False), (":", True), (",", False)]


def test_formats_found_after_the_stream_started_are_used(spark, warehouse, write_file):
    """The registry is read per micro-batch; a file without a format, and settings against the rules, are errors."""
    a, b = write_file("late-file_20240131.csv", "id;v\n1;x,y\n"), write_file("none.csv", "id\n1\n")
    registry, folder = new_folder(spark, "registry"), new_folder(spark, "approvals")
    checkpoint = new_folder(spark, "approved")
    schema = ingest.APPROVAL_SCHEMA

    def run():
        stream = spark.readStream.schema(schema).parquet(folder)
        ingest.stream_ingest(warehouse, stream, checkpoint, True, registry).awaitTermination()

    approve(spark, ("w1", b, "none", None, "2024-01-31 12:00:00", None)).coalesce(1).write.mode("append").parquet(folder)
    run()
    local_rows(spark, [profile(a, "2024-01-05", ";")], PROFILES).write.parquet(f"{registry}/trigger=0")
    approve(
        spark,
        ("w2", a, None, None, "2024-02-01 12:00:00", None, "ann", "other_schema"), ("w3", a, "1bad", ";", "2024-02-01 12:00:00", None),
        ("w4", a, "items", ";", "no time", None), ("w5", a, "items", ";", "2024-02-02 12:00:00", None, ""),
    ).coalesce(1).write.mode("append").parquet(folder)
    run()
    told = {r.workflow_id: r for r in warehouse.table(warehouse.main(EVENTS)).collect()}
    assert {w: r.status for w, r in told.items()} == {"w1": "error", "w2": "completed", "w3": "error", "w4": "error", "w5": "error"}
    assert told["w1"].error_message == ingest.NO_FORMAT
    assert "Invalid table name" in told["w3"].error_message and "Processed By" in told["w5"].error_message
    assert (told["w2"].row_count, told["w2"].processed_by) == (1, "ann")
    assert [tuple(r)[:2] for r in spark.table("other_schema.late_file").collect()] == [("1", "x,y")]


def test_an_approval_of_later_gets_its_own_event(spark, warehouse, write_file):
    path = write_file("a.csv", "id\n1\n")
    rows = [("w1", path, "items", ",", f"2024-01-3{d} 12:00:00", None) for d in (0, 1)]
    for row in rows:  # both are batch 0: the checkpoint was new
        ingest.load_approved(warehouse, approve(spark, row), 0)
        ingest.load_approved(warehouse, approve(spark, row), 0)
    events = warehouse.table(warehouse.main(EVENTS)).collect()
    assert sorted((r.load_time, r.status) for r in events) == [("2024-01-30 12:00:00", "completed"), ("2024-01-31 12:00:00", "completed")]
    assert DelimitedFormat().charset == "utf-8"
