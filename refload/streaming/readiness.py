"""Which dropped files are ready: unchanged for some looks, and in no open workflow."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from refload.functions.text import file_key
from refload.operators.tables import Warehouse
from refload.operators.workflow import COMPLETED, ERROR, GENERATED, current_workflows, skip_in_flight
from refload.session import materialize
from refload.sources.descriptors import DESCRIPTORS, describe_profiles
from refload.sources.profiles import file_formats
from refload.streaming.events import EVENTS, append_events

# Equal looks after which a file is ready, and milliseconds after which an unseen one is forgotten.
LOOKS = 6
IDLE_MS = 3_600_000
# How late a row may come before its time no longer counts; a look or event has its own time.
LATE = "10 minutes"
STATE = "size long, mtime long, looks long, seen long, busy boolean"
READY = "path string, size long, mtime long, scan_id long, looks long"
ORDERED = ["at", "place", "size", "mtime", "gone", "opened", "closed"]


class ReadinessGate(StatefulProcessor):
    """One file: how often it looked the same, and whether a workflow has it.

    A change starts again at 1. A file that has gone, or that a workflow has, is forgotten and counted anew afterwards.
    A timer in the time of the looks removes what was not looked at for ``idle_ms``.
    """

    def __init__(self, looks: int, idle_ms: int) -> None:
        self.wanted, self.idle_ms = looks, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.file.exists()
        size, mtime, looks, seen, busy = self.file.get() if known else (-1, -1, 0, 0, False)
        parts = [np.stack([f[c].to_numpy(np.int64) for c in ORDERED], axis=1) for f in rows]
        found = np.concatenate(parts)
        ready = []
        for at, place, own_size, own_mtime, gone, opened, closed in found[np.lexsort((found[:, 1], found[:, 0]))].tolist():
            seen = max(seen, at)
            if opened or closed:
                busy, looks = bool(opened), 0
            elif gone or busy:
                looks = 0
            else:
                looks = looks + 1 if looks and (own_size, own_mtime) == (size, mtime) else 1
                if looks >= self.wanted:
                    ready.append((key[0], own_size, own_mtime, place, looks))
            if not (opened or closed):
                size, mtime = own_size, own_mtime
        if looks or busy:
            self.file.update((size, mtime, looks, seen, busy))
            if not known:
                self.handle.registerTimer(seen + self.idle_ms)
        elif known:
            self._forget()
        yield pd.DataFrame(ready, columns=["path", "size", "mtime", "scan_id", "looks"]).astype(
            {"size": "int64", "mtime": "int64", "scan_id": "int64", "looks": "int64"}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Forgets the file, or sets the timer anew if it was looked at since."""
        if self.file.exists():
            seen = self.file.get()[3]
            if seen + self.idle_ms <= timerValues.getCurrentWatermarkInMs():
                self.file.clear()
            else:
                self.handle.registerTimer(seen + self.idle_ms)
        yield pd.DataFrame({c: pd.Series(dtype="object" if c == "path" else "int64") for c in ("path", "size", "mtime", "scan_id", "looks")})

    def _forget(self) -> None:
        self.file.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def gate_rows(looks: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Looks (``path, size, mtime, scan_id, looked_at, gone``) and workflow events (``file_path, status, at, seq``) as one stream."""
    no, zero = F.lit(0).cast("long"), F.lit(0).cast("long")
    rows = looks.select(
        file_key(F.col("path")).alias("path"), F.col("looked_at").cast("timestamp").alias("time"), F.col("scan_id").alias("place"),
        "size", "mtime", F.coalesce(F.col("gone"), F.lit(False)).cast("long").alias("gone"), no.alias("opened"), no.alias("closed"),
    )
    if events is None:
        return rows
    over = F.col("status").isin(COMPLETED, ERROR).cast("long")
    told = events.where("file_path IS NOT NULL").select(
        file_key(F.col("file_path")).alias("path"), F.to_timestamp("at").alias("time"), F.col("seq").alias("place"), zero.alias("size"),
        zero.alias("mtime"), no.alias("gone"), (1 - over).alias("opened"), over.alias("closed"),
    )
    return rows.unionByName(told)


def ready_files(looks: DataFrame, events: DataFrame | None = None, wanted: int = LOOKS, idle_ms: int = IDLE_MS, late: str = LATE) -> DataFrame:
    """Stream of (path, size, mtime, scan_id, looks): each look at which a file has been the same for ``wanted`` looks.

    A file comes again at every further look until a workflow has it, so nothing is lost if a batch downstream fails. Rows of a
    file are put in order by time, then number. Needs the RocksDB state store. The processor travels by value.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = gate_rows(looks, events).withWatermark("time", late).withColumn("at", F.unix_millis("time"))
    return rows.groupBy("path").transformWithStateInPandas(
        statefulProcessor=ReadinessGate(wanted, idle_ms), outputStructType=READY, outputMode="Append", timeMode="EventTime"
    )


def profile_ready(wh: Warehouse, ready: DataFrame, batch_id: int, registry: str) -> None:
    """Profile ready files that no open workflow has, and open a workflow for each.

    Workflows are read when the batch runs, so a file is never taken twice even if its event has not come back as a row of
    the stream. Formats are written as this batch's part of the registry; the events come last, so a batch that died between
    runs again over the same files.
    """
    spark = wh.spark
    newest = ready.groupBy("path").agg(F.max_by(F.struct("size", "mtime"), "scan_id").alias("f")).select("path", "f.*")
    if wh.exists(wh.main(EVENTS)):
        flows = current_workflows(full_events(wh)).withColumn("file_path", file_key(F.col("file_path")))
        newest = skip_in_flight(newest, flows, "path", "file_path")
    listing = materialize(newest.select("path", F.col("size").alias("length"), F.timestamp_millis("mtime").alias("modificationTime")), "ready")
    if listing.isEmpty():
        return
    formats = file_formats(spark, listing)
    formats.write.mode("overwrite").parquet(f"{registry}/trigger={batch_id}")
    found = spark.read.parquet(f"{registry}/trigger={batch_id}")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSS")
    append_events(wh, describe_profiles(found, now), DESCRIPTORS)
    key = file_key(F.col("path"))
    opened = found.select(
        F.concat(F.lit("wf_"), F.lower(F.hex(F.xxhash64(key, "modificationTime", F.lit(batch_id))))).alias("workflow_id"),
        F.lit(GENERATED).alias("status"), now.alias("at"),
        F.lit(batch_id).cast("long").alias("seq"), F.col("error").alias("error_message"), F.lit(None).cast("long").alias("row_count"),
        key.alias("file_path"), F.lit(None).cast("string").alias("processed_by"), F.lit(None).cast("string").alias("load_time"),
    )
    append_events(wh, opened)


def full_events(wh: Warehouse) -> DataFrame:
    """The workflow events with every column that ``current_workflows`` asks for."""
    events = wh.table(wh.main(EVENTS))
    kinds = {"user_config": "string", "retry_count": "int", "payload": "string"}
    return events.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in events.columns})


def watch_folder(
    wh: Warehouse, looks: DataFrame, registry: str, checkpoint: str, events: DataFrame | None = None, once: bool = False,
    wanted: int = LOOKS, idle_ms: int = IDLE_MS, every: str = "15 seconds",
) -> StreamingQuery:
    """Looks at a folder, waits until files are ready, profiles them and opens their workflows."""
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return (
        ready_files(looks, events, wanted, idle_ms)
        .writeStream.foreachBatch(lambda df, batch_id: profile_ready(wh, df, batch_id, registry))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
