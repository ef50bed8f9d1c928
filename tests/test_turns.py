"""Several loads of one table at once, turns that were left behind, and folders nobody shows."""

from __future__ import annotations

import os
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest

from refload.operators import turns
from refload.operators.tables import create_table, replace_rows, table_location
from refload.operators.turns import claims, sweep_orphans, turn
from refload.operators.versions import stored_versions
from refload.plans.batch_load import HISTORY, LOG, REGISTRY, load_files
from refload.session import local_rows
from refload.sources.delimited import DelimitedFormat

AT = datetime(2024, 1, 31, 12, 0)


def test_loads_at_once_lose_nothing(spark, warehouse, write_file):
    """Three batches of one table, one of them twice, and one of another table."""
    wh = warehouse
    asked = [(write_file(f"{i}.csv", f"id,v\n{i},x\n{i},y\n"), "items", AT + timedelta(hours=i)) for i in range(3)]
    asked += [asked[1], (write_file("o.csv", "id\n7\n"), "other", AT)]
    with ThreadPoolExecutor(len(asked)) as pool:
        done = list(pool.map(lambda a: load_files(wh, a[0], a[1], DelimitedFormat(), "append", a[2]), asked))
    assert sorted(r.status for r in done) == ["already_loaded", *["success"] * 4]
    rows = sorted((r.id, r.v) for r in wh.table(wh.main("items")).collect())
    assert rows == [(str(i), v) for i in range(3) for v in "xy"]
    assert stored_versions(wh, "items") == [3, 2, 1] and stored_versions(wh, "other") == [1]
    history = wh.table(wh.main(HISTORY)).where("source_table = 'items'").collect()
    assert sorted(r.version for r in history) == [1, 2, 3]
    sizes = {r.ref_data_version_id: r["count"] for r in wh.table(wh.backup("items")).groupBy("ref_data_version_id").count().collect()}
    assert sizes == {1: 2, 2: 4, 3: 6}
    assert sorted(r.source_table for r in wh.table(wh.main(REGISTRY)).collect()) == ["items", "other"]
    assert wh.table(wh.main(LOG)).where("phase = 'load' AND message IS NOT NULL").count() == 5
    assert claims(wh, "items") == claims(wh, REGISTRY) == []


def test_numbers_rise_and_failures_keep_theirs(warehouse):
    wh = warehouse
    with turn(wh, "t", "a", lambda: 4) as mine:
        assert (mine.number, mine.again) == (5, False)
    with pytest.raises(ZeroDivisionError), turn(wh, "u", "b"):
        raise ZeroDivisionError
    with turn(wh, "u", "b") as mine:
        assert (mine.number, mine.again) == (1, True)
    with pytest.raises(ZeroDivisionError), turn(wh, "u", "b", lambda: 1):
        raise ZeroDivisionError
    with turn(wh, "u", "other", lambda: 1) as mine:
        assert mine.number == 3
    with turn(wh, "u", "b", lambda: 3) as mine:  # another came after it
        assert (mine.number, mine.again) == (4, True)
    assert claims(wh, "u") == []


def test_a_turn_left_behind_is_passed_over_and_cannot_settle(warehouse):
    wh = warehouse
    with pytest.raises(turns.TurnLost), turn(wh, "t", "slow"):
        time.sleep(0.3)
        with turn(wh, "t", "next", lease_s=0.2, poll_s=0.05) as mine:
            assert mine.number == 2
    assert [(c.number, c.state) for c in claims(wh, "t")] == [(1, turns.FAILED)]


def test_the_name_of_a_base_may_end_like_a_claim(warehouse):
    with turn(warehouse, "a__1", "x") as mine, turn(warehouse, "a", "y") as other:
        assert mine.number == other.number == 1
        assert [c.batch for c in claims(warehouse, "a")] == ["y"]


def test_folders_that_no_table_shows_are_swept_by_age(spark, warehouse):
    wh, name = warehouse, warehouse.main("items")
    create_table(wh, name, local_rows(spark, [("1",)], "id string"))
    first = os.path.basename(table_location(wh, name))
    for i in (2, 3):
        replace_rows(wh, name, local_rows(spark, [(str(i),)], "id string"))
    root = os.path.dirname(table_location(wh, name).removeprefix("file:"))
    assert sweep_orphans(wh, name) == [] and len(os.listdir(root)) == 3
    for folder, _, files in os.walk(os.path.join(root, first)):
        for path in [folder, *(os.path.join(folder, f) for f in files)]:
            os.utime(path, (1_700_000_000, 1_700_000_000))
    assert sweep_orphans(wh, name, keep=(os.path.join(root, first),)) == []
    assert sweep_orphans(wh, name) == [first]
    assert [r.id for r in wh.table(name).collect()] == ["3"]
