"""Loads, versions and rollbacks that must neither lose nor overwrite anything."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from refload.operators import versions as version_module
from refload.operators.tables import create_table
from refload.operators.validate import not_null
from refload.operators.versions import rollback_to_version, snapshot_version, stored_versions
from refload.plans.batch_load import load_files
from refload.session import local_rows
from refload.sources.delimited import DelimitedFormat, read_header, scan_delimited
from refload.streaming import ingest

AT = datetime(2024, 1, 31, 12, 0)
LATER = datetime(2024, 2, 1, 12, 0)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_a_load_keeps_a_stored_version(spark, warehouse, write_file):
    create_table(warehouse, warehouse.main("items"), local_rows(spark, [("1", "a"), ("2", "b")], "id string, v string"))
    assert snapshot_version(warehouse, "items", AT) == 1
    result = load_files(warehouse, write_file("i.csv", "id,v\n3,c\n"), "items", DelimitedFormat(), "append", LATER)
    assert (result.status, result.version) == ("success", 2)
    backup = warehouse.table(warehouse.backup("items"))
    assert rows_of(backup.where("ref_data_version_id = 1"), "id") == [("1",), ("2",)]
    assert rows_of(backup.where("ref_data_version_id = 2"), "id") == [("1",), ("2",), ("3",)]


def test_other_files_of_the_same_time_are_another_batch(warehouse, write_file):
    first, second = write_file("a.csv", "id,v\n1,x\n"), write_file("b.csv", "id;v\n2;y\n")
    for _ in range(2):
        one = load_files(warehouse, first, "items", DelimitedFormat(), "append", AT)
        two = load_files(warehouse, second, "items", DelimitedFormat(column_delimiter=";"), "append", AT)
    assert (one.status, two.status) == ("already_loaded", "already_loaded")
    assert rows_of(warehouse.table(warehouse.main("items")), "id", "v") == [("1", "x"), ("2", "y")]
    assert stored_versions(warehouse, "items") == [2, 1]


def test_a_load_that_died_after_the_append_is_not_appended_twice(warehouse, write_file, monkeypatch):
    from refload.plans import batch_load

    load_files(warehouse, write_file("a.csv", "id,v\n1,x\n"), "items", DelimitedFormat(), "append", AT)
    path = write_file("b.csv", "id,v\n2,y\n")
    keep = batch_load.snapshot_version

    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(batch_load, "snapshot_version", die)
    with pytest.raises(RuntimeError):
        load_files(warehouse, path, "items", DelimitedFormat(), "append", AT)
    monkeypatch.setattr(batch_load, "snapshot_version", keep)
    assert load_files(warehouse, path, "items", DelimitedFormat(), "append", AT).version == 2
    assert rows_of(warehouse.table(warehouse.main("items")), "id") == [("1",), ("2",)]


def two_versions(warehouse, write_file):
    load_files(warehouse, write_file("a.csv", "id,v\n1,x\n"), "items", DelimitedFormat(), "append", AT)
    load_files(warehouse, write_file("b.csv", "id,v\n2,y\n"), "items", DelimitedFormat(), "append", LATER)


def test_rollback_refuses_what_is_not_there(warehouse, write_file):
    two_versions(warehouse, write_file)
    assert rollback_to_version(warehouse, "items", 9).status == "version_missing"
    assert warehouse.table(warehouse.main("items")).count() == 2


def test_rollback_changes_both_tables_or_none(warehouse, write_file, monkeypatch):
    two_versions(warehouse, write_file)
    point, calls = version_module.point_table, []

    def second_fails(wh, table, location):
        calls.append(table)
        if len(calls) == 2:
            raise RuntimeError("no lock")
        point(wh, table, location)

    monkeypatch.setattr(version_module, "point_table", second_fails)
    assert rollback_to_version(warehouse, "items", 1).status == "error"
    assert rows_of(warehouse.table(warehouse.main("items")), "id") == [("1",), ("2",)]
    monkeypatch.setattr(version_module, "point_table", point)
    done = rollback_to_version(warehouse, "items", 1)
    assert (done.status, done.main_rows, done.stage_rows) == ("success", 1, 1)
    assert rows_of(warehouse.table(warehouse.main("items")), "id") == rows_of(warehouse.table(warehouse.stage("items")), "id") == [("1",)]


def test_headerless_files_and_names_that_differ_by_case(spark, warehouse, write_file):
    plain = DelimitedFormat(has_header=False)
    path = write_file("p.csv", "1,aa\n2,bb\n")
    assert read_header(spark, path, plain) == ([], ["column_1", "column_2"])
    assert load_files(warehouse, path, "plain", plain, "append", AT).rows == 2
    assert rows_of(warehouse.table(warehouse.main("plain")), "column_1", "column_2") == [("1", "aa"), ("2", "bb")]
    assert load_files(warehouse, write_file("c.csv", "Id,ID\n1,2\n"), "cased", DelimitedFormat(), "append", AT).status == "success"
    assert rows_of(warehouse.table(warehouse.main("cased")), "Id", "ID_1") == [("1", "2")]


@pytest.mark.parametrize(
    ("one", "two", "skip"), [("#\nid,v\n1,a\n", "#\nv,id\nb,2\n", 1), ("id,,v\n1,,a\n", "v,,id\nb,,2\n", 0), ("id,id\n1,2\n", "v,id\n3,4\n", 0)]
)
def test_files_with_other_columns_are_refused(spark, write_file, one, two, skip):
    fmt = DelimitedFormat(skip_lines=skip)
    paths = [write_file("one.csv", one), write_file("two.csv", two)]
    assert scan_delimited(spark, paths[0], fmt).count() == 1
    with pytest.raises(ValueError, match="two.csv"):
        scan_delimited(spark, paths, fmt)


def approvals(spark, rows):
    return local_rows(spark, [(*r, *[None] * (14 - len(r))) for r in rows], ingest.APPROVAL_SCHEMA)


def test_approved_formats_reach_the_load(spark, warehouse, write_file):
    write = {n: write_file(n, t) for n, t in {"a.csv": "id,v\n1,x\n", "b.csv": "id;v\n2;'y;z'\nTOTAL;1\n", "c.csv": "id,v\n,q\n"}.items()}
    rows = [
        ("w1", write["a.csv"], "items", ",", "append", "2024-01-31 12:00:00"),
        ("w2", write["b.csv"], "items", ";", "append", "2024-01-31 12:00:00", "'", None, True, True),
        ("w3", write["c.csv"], "items", ",", "append", "2024-02-01 12:00:00"),
        ("w4", write["a.csv"] + ".gone", "items", ",", "append", "2024-02-02 12:00:00"),
    ]
    for _ in range(2):
        ingest.load_approved(warehouse, approvals(spark, rows), 0, rules=lambda base: [not_null(1, "id")])
    assert rows_of(warehouse.table(warehouse.main("items")), "id", "v") == [("1", "x"), ("2", "y;z")]
    told = rows_of(warehouse.table(warehouse.main(ingest.EVENTS)), "workflow_id", "status")
    assert told == [("w1", "completed"), ("w2", "completed"), ("w3", "error"), ("w4", "error")]


def test_a_lost_job_fails_the_batch(spark, warehouse, write_file, monkeypatch):
    def lost(*_, **__):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(ingest, "load_files", lost)
    given = approvals(spark, [("w1", write_file("a.csv", "id\n1\n"), "items", ",", "append", "2024-01-31 12:00:00")])
    with pytest.raises(RuntimeError, match="lost"):
        ingest.load_approved(warehouse, given, 0)
    assert not warehouse.exists(warehouse.main(ingest.EVENTS))


def test_formats_found_fill_what_approvals_leave_open(spark):
    given = approvals(spark, [("w1", "/in/a.csv", "items", None, "append", "t"), ("w2", "/in/b.csv", "items", ",", "append", "t")])
    formats = local_rows(spark, [("file:///in/a.csv", ";", True), ("file:/in/b.csv", "|", True)], "path string, column_delimiter string, has_trailer boolean")
    found = ingest.with_formats(given, formats).orderBy("workflow_id").select("_column_delimiter", "_has_trailer", "_has_header").collect()
    assert [tuple(r) for r in found] == [(";", True, True), (",", True, True)]


def test_statistics_of_no_workflow_outlive_a_purge(spark):
    from refload.operators.workflow import purge_statistics

    stats = local_rows(spark, [("w1", 1), ("w2", 2), ("SYSTEM", 3)], "workflow_id string, n long")
    left = purge_statistics(stats, local_rows(spark, [("w1",)], "workflow_id string"))
    assert rows_of(left.select(F.col("workflow_id")), "workflow_id") == [("SYSTEM",), ("w2",)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from refload import session

    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "yarn"

        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Elsewhere)


def test_loads_log_their_phases(spark, warehouse, write_file):
    from refload.operators.report import load_throughput
    from refload.plans.batch_load import LOG

    load_files(warehouse, write_file("a.csv", "id,v\n1,x\n2,y\n"), "items", DelimitedFormat(), "append", AT, [not_null(1, "id")])
    broken = load_files(warehouse, write_file("b.csv", "id,v\n,x\n"), "items", DelimitedFormat(), "append", LATER, [not_null(1, "id")])
    assert broken.status == "validation_failed"
    log = warehouse.table(warehouse.main(LOG))
    measured = {r.phase: r for r in load_throughput(log.where("load_time < '2024-02-01'"), "phase", "at", F.col("rows")).collect()}
    assert set(measured) == {"load", "stage", "validate", "promote", "snapshot"}
    assert all(r.rows == 2 and r.seconds > 0 for r in measured.values())
    failed = log.where("load_time >= '2024-02-01' AND phase = 'load' AND message IS NOT NULL").first()
    assert "issue_id" in failed.message
