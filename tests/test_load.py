"""Whole loads: promotion, versions, rollback, schema changes."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from refload.operators.load import align_columns, determine_load_type, load_code, next_load_type, noted_load_types
from refload.operators.pages import INDEX, clamp_page, page_version_rows
from refload.operators.registry import match_schema
from refload.operators.tables import VERSION, create_table, replace_rows
from refload.operators.validate import not_null, unique_key
from refload.operators.versions import rollback_to_version, snapshot_version, stored_versions
from refload.plans.batch_load import REGISTRY, load_files
from refload.sources.delimited import DelimitedFormat

DAYS = [datetime(2024, 1, d, 12) for d in range(1, 9)]
CSV = DelimitedFormat()


def rows(wh, table, *columns):
    return sorted((tuple(r) for r in wh.table(table).select(*columns).collect()), key=str)


def test_load_append_and_roll_back(warehouse, write_file):
    wh = warehouse
    one = load_files(wh, write_file("1.csv", "id,name\n1, a \n2,NULL\n"), "items", CSV, "append", DAYS[0])
    assert (one.status, one.load_type, one.rows, one.version) == ("success", "A", 2, 1)
    first = rows(wh, wh.main("items"), "id", "name")
    assert first == [("1", "a"), ("2", None)]

    two = load_files(wh, write_file("2.csv", "ID,size\n3,x\n"), "items", CSV, "append", DAYS[1])
    assert (two.load_type, two.version) == ("A", 2)
    assert rows(wh, wh.main("items"), "id", "name", "size") == [("1", "a", None), ("2", None, None), ("3", None, "x")]

    assert stored_versions(wh, "items") == [2, 1]
    assert rollback_to_version(wh, "items", 1).status == "success"
    assert rows(wh, wh.main("items"), "id", "name") == first
    assert {r[0] for r in rows(wh, wh.main("items"), "ref_data_loadtype")} == {"backup"}


def test_full_load_replaces_and_keeps_columns(warehouse, write_file):
    wh = warehouse
    load_files(wh, write_file("1.csv", "id,name\n1,a\n2,b\n"), "items", CSV, "fullload", DAYS[0])
    done = load_files(wh, write_file("2.csv", "id\n9\n"), "items", CSV, "full", DAYS[1])
    assert done.load_type == "F"
    assert rows(wh, wh.main("items"), "id", "name") == [("9", None)]
    assert [r[0] for r in rows(wh, wh.backup("items"), VERSION)] == [1, 1, 2]


@pytest.mark.parametrize("mode", ["append", "fullload"])
def test_repeating_a_batch_changes_nothing(warehouse, write_file, mode):
    wh = warehouse
    path = write_file("1.csv", "id\n1\n2\n")
    load_files(wh, path, "items", CSV, mode, DAYS[0])
    again = load_files(wh, path, "items", CSV, mode, DAYS[0])
    assert again.status == "already_loaded"
    assert rows(wh, wh.main("items"), "id") == [("1",), ("2",)]
    assert stored_versions(wh, "items") == [1]


def test_interrupted_batch_is_finished_by_repeating_it(warehouse, write_file, monkeypatch):
    """A job lost between promotion and snapshot leaves no double rows and no extra version."""
    wh = warehouse
    load_files(wh, write_file("1.csv", "id\n1\n"), "items", CSV, "append", DAYS[0])
    path = write_file("2.csv", "id\n2\n")

    def lost(*args):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as patch:
        patch.setattr("refload.plans.batch_load.snapshot_version", lost)
        with pytest.raises(RuntimeError):
            load_files(wh, path, "items", CSV, "append", DAYS[1])
    done = load_files(wh, path, "items", CSV, "append", DAYS[1])
    assert (done.status, done.version) == ("success", 2)
    assert rows(wh, wh.main("items"), "id") == [("1",), ("2",)]
    assert stored_versions(wh, "items") == [2, 1]


def test_failed_check_keeps_the_main_table(warehouse, write_file):
    wh = warehouse
    load_files(wh, write_file("1.csv", "id\n1\n"), "items", CSV, "fullload", DAYS[0])
    rules = [not_null(1, "id"), unique_key(2, "id")]
    bad = load_files(wh, write_file("2.csv", "id,x\n7,a\n7,b\nnone,c\n"), "items", CSV, "fullload", DAYS[1], rules)
    assert bad.status == "validation_failed"
    assert bad.validation.startswith('{"validation_result":2')
    assert rows(wh, wh.main("items"), "id") == [("1",)]
    assert len(rows(wh, wh.stage("items"), "id")) == 3


def test_ragged_file_is_set_aside(warehouse, write_file):
    wh = warehouse
    paths = [write_file("1.csv", "id,n\n1,a\n"), write_file("2.csv", "id,n\n2,b\n3,c,d\n")]
    done = load_files(wh, paths, "items", CSV, "append", DAYS[0])
    assert (done.rows, done.rejected_files) == (1, 1)
    assert rows(wh, wh.main("load_errors"), "error") == [("1 records have more fields than the header",)]


def test_header_only_file_is_refused(warehouse, write_file):
    assert load_files(warehouse, write_file("1.csv", "a,b\n"), "items", CSV, "append", DAYS[0]).status == "empty"
    assert not warehouse.exists(warehouse.main("items"))


def test_registry_and_widths(warehouse, write_file):
    wh = warehouse
    load_files(wh, write_file("1.csv", f"id,t\n1,{'x' * 600}\n"), "items", CSV, "append", DAYS[0])
    load_files(wh, write_file("2.csv", f"id,t\n1,{'x' * 5000}\n"), "items", CSV, "append", DAYS[1])
    assert rows(wh, wh.main(REGISTRY), "ref_name", "source_table") == [("ref_items", "items")]
    comments = {f.name: f.metadata.get("comment") for f in wh.table(wh.main("items")).schema.fields}
    assert comments["t"] == "varchar(4000)"
    stage = {f.name: f.metadata.get("comment") for f in wh.table(wh.stage("items")).schema.fields}
    assert stage["t"] == "varchar(MAX)"


def test_rollback_outcomes(warehouse):
    assert rollback_to_version(warehouse, "bad-name", 1).status == "invalid_base_name"
    assert rollback_to_version(warehouse, "", 1).status == "invalid_base_name"
    assert rollback_to_version(warehouse, "missing", 1).status == "main_missing"
    create_table(warehouse, warehouse.main("lonely"), warehouse.spark.range(3))
    lost = rollback_to_version(warehouse, "lonely", 1)
    assert lost.status == "error" and lost.error
    assert warehouse.table(warehouse.main("lonely")).count() == 3


def test_snapshot_repeated_under_its_number(warehouse):
    wh = warehouse
    create_table(wh, wh.main("t"), wh.spark.range(5))
    for _ in range(2):
        assert snapshot_version(wh, "t", DAYS[0], 1) == 1
    assert wh.table(wh.backup("t")).count() == 5


def test_table_may_be_replaced_from_itself(warehouse):
    wh = warehouse
    create_table(wh, wh.main("t"), wh.spark.range(6))
    replace_rows(wh, wh.main("t"), wh.table(wh.main("t")).where("id > 2"))
    assert sorted(r.id for r in wh.table(wh.main("t")).collect()) == [3, 4, 5]


def test_load_types(spark):
    assert [load_code(w) for w in ("full", "FULLLOAD", " f ", "append", "a", "x", None)] == ["F", "F", "F", "A", "A", None, None]
    types = {("F", "A"): "F", ("A",): "A", (" a ",): "A", ("backup",): "A", (): "A"}
    for stored, expected in types.items():
        main = spark.createDataFrame([(t,) for t in stored], "ref_data_loadtype string")
        assert determine_load_type(main, "append") == expected
    assert determine_load_type(None, "fullload") == "F"
    assert determine_load_type(None, "fullload", "append") == "A"


def test_load_types_are_noted_with_the_table(spark, warehouse, write_file, monkeypatch):
    """The next load's type comes from what loads noted; the rows are not read."""
    wh, name = warehouse, warehouse.main("items")
    assert next_load_type(wh, "items", "fullload") == "F"
    load_files(wh, write_file("1.csv", "id\n1\n"), "items", CSV, "append", DAYS[0])
    assert noted_load_types(wh, name) == {"A"}
    monkeypatch.setattr("refload.operators.load.determine_load_type", lambda *_: pytest.fail("rows were read"))
    assert next_load_type(wh, "items", "fullload") == "A" and next_load_type(wh, "items", "append", "full") == "F"
    load_files(wh, write_file("2.csv", "id\n2\n"), "items", CSV, "append", DAYS[1], override="F")
    assert noted_load_types(wh, name) == {"F"}
    load_files(wh, write_file("3.csv", "id\n3\n"), "items", CSV, "append", DAYS[2], override="A")
    assert noted_load_types(wh, name) == {"A", "F"} and next_load_type(wh, "items", "append") == "F"
    rollback_to_version(wh, "items", 1)
    assert noted_load_types(wh, name) == set() and next_load_type(wh, "items", "append") == "A"
    monkeypatch.undo()
    create_table(wh, wh.main("other"), spark.sql("SELECT 1 AS id, 'F' AS ref_data_loadtype"))
    assert noted_load_types(wh, wh.main("other")) is None
    assert next_load_type(wh, "other", "append") == "F" and noted_load_types(wh, wh.main("other")) == {"F"}


def test_no_common_columns(spark):
    with pytest.raises(ValueError):
        align_columns(spark.range(1).toDF("a"), spark.range(1).toDF("b"))


def test_pages(spark, warehouse):
    assert clamp_page("x", "y") == (50, 0)
    assert clamp_page(0, -3) == (1, 0)
    assert clamp_page(5000, "7") == (1000, 7)
    wh = warehouse
    rows = spark.range(997).select((F.col("id") * 31 % 997 - 1).alias("k"), (F.col("id") % 3).alias("v"))
    rows = rows.union(rows.where("k < 100")).withColumn("k", F.when(F.col("k") >= 0, F.col("k")))
    create_table(wh, wh.main("numbers"), rows)
    snapshot_version(wh, "numbers", DAYS[0])
    want = sorted(((r.k, r.v) for r in rows.collect()), key=lambda t: (t[0] is not None, t))
    got, offset = [], 0
    while offset is not None:
        page = page_version_rows(wh, "numbers", 1, 250, offset)
        assert (page.total, page.limit, page.offset, page.columns[:2]) == (len(want), 250, offset, ["k", "v"])
        got += [(r.k, r.v) for r in page.rows.collect()]
        offset = page.next_offset
    assert got == want
    assert page_version_rows(wh, "numbers", 1, 10, 5000).rows.collect() == []
    noted = wh.table(wh.main(INDEX)).count()
    plan = page.rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "_place" in plan
    assert wh.table(wh.main(INDEX)).count() == noted and len({r.location for r in wh.table(wh.main(INDEX)).collect()}) == 1
    replace_rows(wh, wh.main("numbers"), rows.limit(3))
    snapshot_version(wh, "numbers", DAYS[0], 1)  # stored anew: another index
    assert page_version_rows(wh, "numbers", 1).total == 3
    assert [page_version_rows(wh, *a).error for a in (("no such; name", 1), ("nothing", 1), ("numbers", 9))] == [
        "invalid_base_name", "backup_missing", "version_missing",
    ]


def test_match_schema_finds_every_pair(spark):
    """Prefix search against comparing every set with every other."""
    import itertools
    import random

    random.seed(7)
    names = [f"c{i}" for i in range(14)]
    sets = {
        side: {f"{side}{i}": frozenset(random.sample(names, random.randint(1, 12))) for i in range(120)} for side in "ft"
    }

    def relation(side):
        return spark.createDataFrame([(o, n.upper()) for o, ns in sets[side].items() for n in ns], f"{side} string, n string")

    found = match_schema(relation("f"), relation("t"), "f", "t", "n").collect()
    got = {(frozenset(r.file_names), frozenset(r.table_names)) for r in found}
    pairs = itertools.product(set(sets["f"].values()), set(sets["t"].values()))
    assert got == {(a, b) for a, b in pairs if len(a & b) / len(a | b) > 0.7}


@pytest.mark.parametrize("encoding", ["cp1252", "utf-16", "iso-8859-1", "utf-8-sig"])
def test_encodings(warehouse, write_file, encoding):
    wh = warehouse
    path = write_file("1.csv", "größe,id\nça – va,1\n".replace("–", "–" if encoding != "iso-8859-1" else "-").encode(encoding))
    fmt = DelimitedFormat(encoding=encoding)
    assert load_files(wh, path, "items", fmt, "append", DAYS[0]).status == "success"
    dash = "-" if encoding == "iso-8859-1" else "–"
    assert rows(wh, wh.main("items"), "gr__e", "id") == [(f"ça {dash} va", "1")]
