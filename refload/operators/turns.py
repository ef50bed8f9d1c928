"""Turns of loads at one table: numbered claims that only one load can make.

The catalog decides: a claim is the creation of a table of its number, and no two creations of one name succeed. Loads
publish in the order of their numbers, which are also the versions they store. A load that fails gives its turn up; one that
vanished loses it when its lease is over.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from refload.operators.tables import Warehouse, table_location
from refload.sources.listing import file_system

#: Seconds after which a claim that nobody gave up counts as left behind, and between two looks at those before.
LEASE_S, POLL_S = 3600.0, 0.2
OPEN, FAILED = "open", "failed"


class TurnLost(RuntimeError):
    """The lease was over before the load was; another may have gone on."""


@dataclass(frozen=True)
class Claim:
    number: int
    batch: str
    owner: str
    state: str
    at: float


@dataclass(frozen=True)
class Turn:
    """A place in the order, and whether its batch had one before (it may then have published in part)."""

    number: int
    again: bool


def _schema(wh: Warehouse) -> str:
    return f"{wh.data_schema}_turns"


def _name(wh: Warehouse, base: str, number: int) -> str:
    return f"`{_schema(wh)}`.`{base}__{number}`"


def claims(wh: Warehouse, base: str) -> list[Claim]:
    """All claims at a table that were not settled, by number."""
    wh.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{_schema(wh)}` LOCATION '{wh.root}/{_schema(wh)}'")
    names = [r.tableName for r in wh.spark.sql(f"SHOW TABLES IN `{_schema(wh)}` LIKE '{base.lower()}__*'").collect()]
    found = []
    for name in names:
        number = re.fullmatch(rf"{re.escape(base.lower())}__(\d+)", name)
        if not number:
            continue
        try:
            told = {r.key: r.value for r in wh.spark.sql(f"SHOW TBLPROPERTIES `{_schema(wh)}`.`{name}`").collect()}
        except AnalysisException:
            continue  # settled meanwhile
        if "turn.batch" in told:
            found.append(Claim(int(number[1]), *(told[f"turn.{k}"] for k in ("batch", "owner", "state")), float(told["turn.at"])))
    return sorted(found, key=lambda c: c.number)


def _try_claim(wh: Warehouse, base: str, number: int, batch: str, owner: str) -> bool:
    told = f"'turn.batch' = '{batch}', 'turn.owner' = '{owner}', 'turn.state' = '{OPEN}', 'turn.at' = '{time.time()}'"
    place = f"{wh.root}/{_schema(wh)}/{base.lower()}__{number}"
    try:
        wh.spark.sql(f"CREATE TABLE {_name(wh, base, number)} (x INT) USING parquet LOCATION '{place}' TBLPROPERTIES ({told})")
    except AnalysisException as problem:
        if problem.getCondition() == "TABLE_OR_VIEW_ALREADY_EXISTS":
            return False
        raise
    return True


def _mark(wh: Warehouse, base: str, number: int, state: str) -> None:
    wh.spark.sql(f"ALTER TABLE {_name(wh, base, number)} SET TBLPROPERTIES ('turn.state' = '{state}')")


def _settle(wh: Warehouse, base: str, number: int) -> None:
    wh.spark.sql(f"DROP TABLE IF EXISTS {_name(wh, base, number)}")


def still_mine(wh: Warehouse, base: str, number: int, owner: str) -> bool:
    return any(c.number == number and c.owner == owner and c.state == OPEN for c in claims(wh, base))


@contextmanager
def turn(wh: Warehouse, base: str, batch: str, used: Callable[[], int] | None = None, lease_s: float = LEASE_S, poll_s: float = POLL_S) -> Iterator[Turn]:
    """Wait for the turn of a batch at a table and hold it.

    ``used()`` gives the highest number taken otherwise (stored versions). A batch that failed gets its number again if none
    came after it, else a new one. The same batch by another owner is waited for. At the end the claim is settled; after an
    exception it stays as failed, so that the batch is known when it comes again.
    """
    owner = uuid.uuid4().hex
    again, number = False, None
    while number is None:
        found = claims(wh, base)
        now = time.time()
        mine = [c for c in found if c.batch == batch]
        if any(c.state == OPEN and now - c.at < lease_s for c in mine):
            time.sleep(poll_s)
            continue
        again = bool(mine)
        top = max([used() if used else 0, *(c.number for c in found)], default=0)
        for old in mine:
            if old.number == top and not (used and used() > top):
                _settle(wh, base, old.number)
                top = old.number - 1
        if _try_claim(wh, base, top + 1, batch, owner):
            number = top + 1
            for old in mine:
                if old.number != number:
                    _settle(wh, base, old.number)
    try:
        while True:
            before = [c for c in claims(wh, base) if c.number < number and c.state == OPEN]
            for c in before:
                if time.time() - c.at >= lease_s:
                    _mark(wh, base, c.number, FAILED)
            if not [c for c in before if time.time() - c.at < lease_s]:
                break
            time.sleep(poll_s)
        yield Turn(number, again)
        if not still_mine(wh, base, number, owner):
            raise TurnLost(f"{base}: turn {number} was over its lease")
        _settle(wh, base, number)
    except BaseException:
        if still_mine(wh, base, number, owner):
            _mark(wh, base, number, FAILED)
        raise


def sweep_orphans(wh: Warehouse, table: str, hours: float = 24.0, keep: tuple[str, ...] = ()) -> list[str]:
    """Remove folders of a table that it no longer shows, if nothing in them is younger than ``hours``; returns their names.

    A load that is under way writes to a young folder, and a reader that began before a swap may still read the old one: the
    age must be longer than both. ``keep`` names folders that something else refers to (page indexes).
    """
    store, root = file_system(f"{wh.root}/{table.replace('.', '/')}")
    _, shown = file_system(table_location(wh, table)) if wh.exists(table) else (None, "")
    kept = {file_system(k)[1].rstrip("/") for k in keep} | {shown.rstrip("/")}
    old, gone = datetime.now().astimezone() - timedelta(hours=hours), []
    for folder in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if folder.type != pafs.FileType.Directory or folder.path in kept:
            continue
        inside = store.get_file_info(pafs.FileSelector(folder.path, recursive=True))
        times = [f.mtime for f in [folder, *inside] if f.mtime is not None]
        if times and max(times) < old:
            store.delete_dir(folder.path)
            gone.append(folder.base_name)
    return sorted(gone)


def page_folders(wh: Warehouse, index: str) -> tuple[str, ...]:
    """Folders that the page index refers to."""
    if not wh.exists(index):
        return ()
    return tuple(r.location for r in wh.table(index).select(F.col("location")).distinct().collect())
