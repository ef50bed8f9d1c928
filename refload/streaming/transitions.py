"""Workflows as state machines over a stream of requests."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from refload.operators.tables import Warehouse, append_rows, create_table
from refload.operators.workflow import APPROVED, COMPLETED, ERROR, GENERATED, MILESTONES, PENDING, PROCESSING, STATES, STUCK_HOURS, pending
from refload.streaming.events import EVENTS

REFUSED = "refused_requests"
LATE = "10 minutes"
MICROS = 1_000_000
TIMES = ["created_at", *MILESTONES.values()]
STATE = "status string, changed long, seq long, " + ", ".join(f"{t} long" for t in TIMES)
#: Milestones in the order of their states, as the processor keeps them.
MARKED = [GENERATED, APPROVED, COMPLETED]


class TransitionMachine(StatefulProcessor):
    """One workflow: its status, when it changed, and when it reached its milestones.

    Every request comes out, accepted or refused with a reason. A workflow that is processed for too long becomes an
    error by a timer. The clock is that of the requests (then a request that comes after the time limit finds the error, in
    whichever batch the two arrive), or that of the machine.
    """

    def __init__(self, states: list[str], stuck_hours: float, machine_clock: bool) -> None:
        self.states, self.stuck, self.machine_clock = states, int(stuck_hours * 3600 * MICROS), machine_clock
        self.message = f"Processing timeout after {stuck_hours}:00:00"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [(f["at_micros"].to_numpy(np.int64), f["seq"].to_numpy(np.int64), f["status"].to_numpy(object)) for f in rows]
        at, seq, asked = (np.concatenate(c) for c in zip(*parts, strict=True))
        status, changed, last, *times = self.flow.get() if self.flow.exists() else ("", -1, -1, *[-1] * len(TIMES))
        began, made = status == PROCESSING, []
        for i in np.lexsort((seq, at)).tolist():
            now, wanted = int(at[i]), asked[i]
            if status == PROCESSING and not self.machine_clock and now >= changed + self.stuck:
                made.append((last, ERROR, status, changed + self.stuck, True, self.message, *times))
                status, changed = ERROR, changed + self.stuck
            if wanted not in self.states:
                made.append((int(seq[i]), wanted, status, now, False, f"Invalid workflow status: {wanted}", *times))
                continue
            times = [now if times[0] < 0 else times[0], *(now if s == wanted else t for s, t in zip(MARKED, times[1:], strict=True))]
            made.append((int(seq[i]), wanted, status, now, True, "", *times))
            status, changed, last = wanted, now, int(seq[i])
        if status:
            self.flow.update((status, changed, last, *times))
        if began or status == PROCESSING:
            self._wait(status, changed, timerValues)
        yield self._rows(key, made)

    def _wait(self, status: str, changed: int, timerValues) -> None:  # noqa: N803
        """One timer for a workflow that is being processed, none for others."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == PROCESSING:
            start = timerValues.getCurrentProcessingTimeInMs() if self.machine_clock else changed // 1000
            self.handle.registerTimer(start + self.stuck // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        made = []
        if self.flow.exists():
            status, changed, last, *times = self.flow.get()
            if status == PROCESSING:
                now = timerValues.getCurrentProcessingTimeInMs() * 1000 if self.machine_clock else changed + self.stuck
                made = [(last, ERROR, status, now, True, self.message, *times)]
                self.flow.update((ERROR, now, last, *times))
        yield self._rows(key, made)

    def _rows(self, key, made: list[tuple]) -> pd.DataFrame:
        names = ["seq", "status", "previous", "at_micros", "accepted", "reason", *TIMES]
        frame = pd.DataFrame(made, columns=names)
        frame.insert(0, "workflow_id", [key[0]] * len(made))
        whole = {c: "int64" for c in ("seq", "at_micros", *TIMES)}
        return frame.astype(whole | {"accepted": "bool"})

    def close(self) -> None:
        pass


def transition_stream(
    requests: DataFrame, stuck_hours: float = STUCK_HOURS, late: str = LATE, machine_clock: bool = False, states: list[str] = STATES
) -> DataFrame:
    """Every request (``workflow_id, status, at, seq``) with ``accepted`` and a reason, the status before it, and milestone times.

    A status that does not exist is refused. Too long in processing gives a row of its own, an error. Rows of a workflow are put in
    order by time and number. Needs the RocksDB state store. With ``machine_clock`` the query never runs out of work.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    kind = requests.schema["workflow_id"].dataType.simpleString()
    shaped = requests.select("workflow_id", F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "status")
    shaped = shaped.withWatermark("at", late).withColumn("at_micros", F.unix_micros("at"))
    out = f"workflow_id {kind}, seq long, status string, previous string, at_micros long, accepted boolean, reason string, "
    made = shaped.groupBy("workflow_id").transformWithStateInPandas(
        statefulProcessor=TransitionMachine(list(states), stuck_hours, machine_clock),
        outputStructType=out + ", ".join(f"{t} long" for t in TIMES),
        outputMode="Append",
        timeMode="ProcessingTime" if machine_clock else "EventTime",
    )
    times = {t: F.when(F.col(t) >= 0, F.timestamp_micros(F.col(t))) for t in TIMES}
    return made.withColumns(times | {"at": F.timestamp_micros("at_micros")}).drop("at_micros")


def _append_new(wh: Warehouse, name: str, rows: DataFrame) -> None:
    """Append rows that the table does not hold yet, so that a batch may be written twice."""
    if not wh.exists(name):
        create_table(wh, name, rows)
        return
    keys = ["workflow_id", "seq", "status"]
    append_rows(wh, name, rows.join(wh.table(name).select(keys), keys, "left_anti"))


def record_transitions(wh: Warehouse, transitions: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Accepted requests into the workflow events, refused ones into a table of their own, from one stream."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("workflow_id", F.col("workflow_id").cast("string")).persist()
        try:
            told = batch.select(
                "workflow_id", "status", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "seq",
                F.nullif("reason", F.lit("")).alias("error_message"), F.lit(None).cast("long").alias("row_count"),
                *[F.lit(None).cast("string").alias(c) for c in ("file_path", "processed_by", "load_time")], "accepted",
            )
            for wanted, name in ((True, EVENTS), (False, REFUSED)):
                rows = told.where(F.col("accepted") == wanted).drop("accepted")
                if not rows.isEmpty():
                    _append_new(wh, wh.main(name), rows)
        finally:
            batch.unpersist()

    trigger = {"availableNow": True} if once else {"processingTime": "15 seconds"}
    return transitions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def newest_changes(changes: DataFrame, key: str = "workflow_id") -> DataFrame:
    """The newest change of settings of each workflow, kept by the stream: (key, ready, at, seq) whenever it is another one."""
    newest = F.max_by(F.struct("ready", "at", "seq"), F.struct("at", "seq")).alias("_c")
    return changes.groupBy(key).agg(newest).select(key, "_c.*")


def recheck_stream(
    changes: DataFrame, workflows: Callable[[], DataFrame], path: str, checkpoint: str, once: bool = False, key: str = "workflow_id"
) -> StreamingQuery:
    """Pending workflows whose newest change makes them ready, a part of ``path`` a batch; the batch form is ``recheck_pending``.

    A later "not ready" is written as well (``status`` as it was before the form): the last row of a workflow holds.
    ``workflows`` is called in each batch, for the states of that moment.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        waiting = pending(workflows()).select(key)
        status = F.when(F.col("ready"), F.lit(GENERATED)).otherwise(F.lit(PENDING)).alias("status")
        batch.join(waiting, key, "left_semi").select(key, "ready", "at", "seq", status).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    trigger = {"availableNow": True} if once else {"processingTime": "15 seconds"}
    writer = newest_changes(changes, key).writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
