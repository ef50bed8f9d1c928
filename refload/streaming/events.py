"""The table of workflow events that streams write and read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from refload.operators.tables import Warehouse, append_rows, create_table

EVENTS = "workflow_events"
EVENT_SCHEMA = (
    "workflow_id string, status string, at string, seq long, error_message string, row_count long, file_path string, "
    "processed_by string, load_time string"
)


def append_events(wh: Warehouse, events: DataFrame, table: str = EVENTS) -> None:
    name = wh.main(table)
    if wh.exists(name):
        append_rows(wh, name, events)
    else:
        create_table(wh, name, events)
