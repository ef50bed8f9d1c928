"""The listing of a folder as a stream: what lies there, look after look.

Spark's file source names a file once and never again; whether a file still grows, was dropped anew or has gone can
only be seen by looking twice. This source looks at a folder once a trigger, writes what it saw to a log folder and
gives the rows of that look. Offsets are numbers of looks, so a batch that runs again reads the look it read before, and
a restarted query goes on with the next number.
"""

from __future__ import annotations

import fnmatch
import json
import os
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SOURCE = "folder_looks"
SCHEMA = "path string, size long, mtime long, scan_id long, looked_at timestamp, gone boolean"
ARROW = pa.schema(
    [
        ("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("scan_id", pa.int64()),
        ("looked_at", pa.timestamp("us", tz="UTC")), ("gone", pa.bool_()),
    ]
)
#: Rows of a look that one task reads.
PART_ROWS = 100_000


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder and its path there; a path without scheme is local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(uri))


def listed(folder: str, glob: str, recursive: bool = False) -> dict[str, tuple[int, int]]:
    """Size and time (milliseconds) of the files of a folder, by path; a folder that is not there holds none."""
    store, path = file_system(folder)
    found = store.get_file_info(pafs.FileSelector(path, recursive=recursive, allow_not_found=True))
    files = (f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, glob))
    return {f.path: (f.size, (f.mtime_ns or 0) // 1_000_000) for f in files}


@dataclass
class Look(InputPartition):
    """A part of a stored look."""

    path: str


class FolderReader(DataSourceStreamReader):
    """Looks at the folder whenever Spark asks how far the stream has come."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.log = options["path"], options["log"]
        self.glob = options.get("glob", "*")
        self.recursive = options.get("recursive", "false").lower() == "true"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"scan": 0}

    def _looks(self) -> dict[int, list[str]]:
        """Parts of the stored looks by number; a look counts once its list of parts is there."""
        store, path = file_system(self.log)
        infos = store.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        done = {int(f.base_name[5:-5]): f.path for f in infos if f.base_name.endswith(".json")}
        return {n: json.loads(store.open_input_stream(p).read()) for n, p in done.items()}

    def latestOffset(self) -> dict:  # noqa: N802
        """Looks once more, and stores what is there and what has gone since the look before."""
        looks = self._looks()
        last = max(looks, default=0)
        now = listed(self.folder, self.glob, self.recursive)
        before = {} if not last else self._stored(looks[last])
        at, scan = int(time.time() * 1_000_000), last + 1
        rows = [(p, size, mtime, scan, at, False) for p, (size, mtime) in sorted(now.items())]
        rows += [(p, size, mtime, scan, at, True) for p, (size, mtime) in sorted(before.items()) if p not in now]
        store, path = file_system(self.log)
        store.create_dir(path, recursive=True)
        parts = []
        for k in range(0, len(rows), PART_ROWS):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows[k : k + PART_ROWS], strict=True), ARROW.types, strict=True)]
            parts.append(f"{path}/look-{scan}-{k}.parquet")
            pq.write_table(pa.table(columns, schema=ARROW), parts[-1], filesystem=store)
        with store.open_output_stream(f"{path}/half-{scan}") as out:
            out.write(json.dumps(parts).encode())
        store.move(f"{path}/half-{scan}", f"{path}/look-{scan}.json")
        return {"scan": scan}

    def _stored(self, parts: list[str]) -> dict[str, tuple[int, int]]:
        store, _ = file_system(self.log)
        tables = [pq.read_table(p, filesystem=store) for p in parts]
        return {r["path"]: (r["size"], r["mtime"]) for t in tables for r in t.to_pylist() if not r["gone"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        looks = self._looks()
        return [Look(p) for n in range(start["scan"] + 1, end["scan"] + 1) for p in looks.get(n, [])]

    def read(self, partition: Look) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.log)
        yield from pq.read_table(partition.path, filesystem=store, schema=ARROW).to_batches()

    def commit(self, end: dict) -> None:
        """Looks before the last one are done with; the last one is what the next is compared with."""
        store, path = file_system(self.log)
        for n, parts in self._looks().items():
            if n < end["scan"]:
                for p in [f"{path}/look-{n}.json", *parts]:
                    store.delete_file(p)


class FolderLooks(DataSource):
    """``path`` (the folder), ``log`` (a shared folder of the stream's own), ``glob``, ``recursive``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:  # noqa: N802
        return FolderReader(dict(self.options))


def folder_looks(spark: SparkSession, folder: str, log: str, glob: str = "*.csv", recursive: bool = False) -> DataFrame:
    """Stream of looks at a folder: every file at every look, and once more, as ``gone``, when it is no longer there.

    A trigger is a look; a run with ``availableNow`` looks once. ``log`` must outlive the query like its checkpoint. The
    listing itself is made by the driver, as Spark's own file source makes it; its rows are read by tasks.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FolderLooks)
    options = {"log": log, "glob": glob, "recursive": str(recursive).lower()}
    return spark.readStream.format(SOURCE).options(**options).load(folder)
