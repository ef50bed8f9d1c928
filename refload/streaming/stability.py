"""Counting equal looks at a file, over a stream of folder listings."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed value: milliseconds after which a file no longer seen is forgotten.
IDLE_MS = 3_600_000
STATE = "size double, mtime long, count long"
OUTPUT = "path string, scan_id long, stable_count long"


class StabilityCounter(StatefulProcessor):
    """Keeps size, time and count of each file; a change starts again at 1."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", STATE, ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Scans of one file arrive in batches, in any order; three numbers of each are held and put in order by scan.

        The count of a run of equal looks is its place in the run, plus what the state holds for the first run.
        """
        parts = [(f["scan_id"].to_numpy(np.int64), f["size"].to_numpy(float), f["mtime"].to_numpy(np.int64)) for f in rows]
        scan, size, mtime = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(scan, kind="stable")
        scan, size, mtime = scan[order], size[order], mtime[order]
        changed = np.concatenate(([True], (size[1:] != size[:-1]) | (mtime[1:] != mtime[:-1])))
        places = np.arange(len(scan))
        starts = np.maximum.accumulate(np.where(changed, places, 0))
        count = places - starts + 1
        if self.seen.exists():
            old_size, old_mtime, before = self.seen.get()
            if size[0] == old_size and mtime[0] == old_mtime:
                count = count + (starts == 0) * before
        self.seen.update((float(size[-1]), int(mtime[-1]), int(count[-1])))
        yield pd.DataFrame({"path": key[0], "scan_id": scan, "stable_count": count.astype(np.int64)})

    def close(self) -> None:
        pass


def stream_stability(listings: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Stable count of each scan in a stream with ``path, scan_id, size, mtime``; needs the RocksDB state store.

    Forgetting idle files takes a clock, and a query with a clock never runs out of work: give
    ``idle_ms=None`` for a run that ends when everything has been read. The processor travels by value, so
    executors need not have this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return listings.groupBy("path").transformWithStateInPandas(
        statefulProcessor=StabilityCounter(idle_ms),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
