"""Loads driven by a stream of approvals, and streams of workflow events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refload.functions.text import base_name, file_key, table_base_name
from refload.operators.tables import Warehouse
from refload.operators.validate import Rule
from refload.operators.workflow import COMPLETED, ERROR, canonical_load_config, validate_load_config
from refload.plans.batch_load import load_files
from refload.session import local_rows, materialize
from refload.sources.delimited import DelimitedFormat
from refload.sources.descriptors import DESCRIPTORS, newest_descriptors, persist_inferred_schema
from refload.streaming.events import EVENT_SCHEMA, EVENTS, append_events

# What an approval says of its file; what it leaves open is taken from the format found for the file, else a default.
FORMAT_COLUMNS = {
    "column_delimiter": ("delimiter", ","), "text_qualifier": ("text_qualifier", '"'), "encoding": ("encoding", "utf-8"),
    "has_header": ("has_headers", True), "has_trailer": ("has_trailer", False), "skip_lines": ("skip_lines", 0),
}
APPROVAL_SCHEMA = (
    "workflow_id string, file_path string, base string, delimiter string, mode string, load_time string, "
    "text_qualifier string, encoding string, has_headers boolean, has_trailer boolean, skip_lines int, "
    "processed_by string, target_schema string, approved_at timestamp"
)
# What of a profile decides a load.
PROFILE_SCHEMA = (
    "path string, modificationTime timestamp, column_delimiter string, text_qualifier string, encoding string, has_header boolean, "
    "has_trailer boolean, skip_lines int, error string, trigger long"
)
# Failures that lie in the data or the settings: trying again would not help.
OTHER_COLUMNS = "CSV header does not conform to the schema"
NO_FORMAT = "No format was approved for this file and none was found"
UNKNOWN_PERSON = "Unknown"


def read_registry(wh: Warehouse, registry: str | None) -> DataFrame:
    """The profiles stored by now; none if there is no registry yet. Called per micro-batch, so later profiles are seen."""
    empty = local_rows(wh.spark, [], PROFILE_SCHEMA)
    if registry is None:
        return empty
    try:
        return wh.spark.read.schema(PROFILE_SCHEMA).parquet(registry)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise


def with_formats(approvals: DataFrame, formats: DataFrame | None = None) -> DataFrame:
    """Approvals with a value for every format column, and ``_known``: whether a format was approved or found.

    ``formats`` are profiles by ``path``. A file may have been dropped and profiled again and again: the profile of the newest
    file time that is not later than the approval (``approved_at``; open: any) is taken, of several the one made last. Joined
    profiles are cut to one a (file, approval) by an aggregate, so no list of a file's profiles is held.
    """
    found, known = approvals, []
    if formats is not None:
        known = [c for c in FORMAT_COLUMNS if c in formats.columns]
        order = [c for c in ("modificationTime", "trigger") if c in formats.columns]
        good = formats.where("error IS NULL") if "error" in formats.columns else formats
        profiles = good.select(file_key(F.col("path")).alias("_key"), F.struct(*known).alias("_profile"), *[F.col(c).alias(f"_{c}") for c in order])
        asked = approvals.select(
            file_key(F.col("file_path")).alias("_key"),
            (F.col("approved_at") if "approved_at" in approvals.columns else F.lit(None).cast("timestamp")).alias("_asof"),
        ).distinct()
        met = asked.join(profiles, "_key")
        if "_modificationTime" in met.columns:
            met = met.where(F.col("_asof").isNull() | (F.col("_modificationTime") <= F.col("_asof")))
        newest = F.max_by("_profile", F.struct(*[f"_{c}" for c in order])) if order else F.max("_profile")
        chosen = met.groupBy("_key", "_asof").agg(newest.alias("_found"))
        chosen = chosen.select(F.col("_key").alias("_of"), F.col("_asof").alias("_until"), "_found")
        until = F.col("approved_at") if "approved_at" in approvals.columns else F.lit(None).cast("timestamp")
        found = found.join(chosen, (file_key(F.col("file_path")) == F.col("_of")) & until.eqNullSafe(F.col("_until")), "left").drop("_of", "_until")
    out = {}
    for name, (given, default) in FORMAT_COLUMNS.items():
        choices = [F.col(given)] if given in approvals.columns else []
        choices += [F.col(f"_found.{name}")] if name in known else []
        out[f"_{name}"] = F.coalesce(*choices, F.lit(default))
    approved = F.col("delimiter").isNotNull() if "delimiter" in approvals.columns else F.lit(False)
    return found.withColumns({**out, "_known": approved | (F.col("_found").isNotNull() if known else F.lit(False))})


def checked_approvals(approvals: DataFrame, formats: DataFrame | None) -> DataFrame:
    """Approvals with formats, a table name, the person, and ``_refused``: why they must not be loaded, or null.

    Settings go through the same spelling and rules as a form: an approval is confirmed by being one. A blank table name is
    taken from the file's name.
    """
    made = with_formats(approvals, formats)
    blank = F.trim(F.coalesce("base", F.lit(""))) == ""
    made = made.withColumn("base", F.when(blank, table_base_name(base_name(F.col("file_path")))).otherwise(F.trim("base")))
    text = {
        "delimiter": F.coalesce("delimiter", "_column_delimiter"), "text_qualifier": F.col("_text_qualifier"),
        "encoding": F.coalesce("encoding", F.lit("utf-8")), "processing_mode": F.col("mode"), "table_name": F.col("base"),
        "processed_by": F.coalesce("processed_by", F.lit(UNKNOWN_PERSON)), "process_date": F.lit(""), "has_headers": F.lit("Yes"),
        "is_reference_data": F.lit("Yes"), "confirmed": F.lit("Yes"),
    }
    form = made.select(F.struct(*made.columns).alias("_row"), *[v.cast("string").alias(k) for k, v in text.items()])
    judged = validate_load_config(canonical_load_config(form))
    refused = F.when(~F.col("_row._known"), F.lit(NO_FORMAT)).when(~F.col("valid"), F.array_join("errors", "; "))
    told = judged.select("_row", refused.alias("_refused"), F.col("processed_by").alias("_person"), F.col("delimiter").alias("_delimiter"))
    return told.select("_row.*", "_refused", "_person", "_delimiter").withColumn("_column_delimiter", F.col("_delimiter")).drop("_delimiter")


def data_problem(problem: Exception) -> bool:
    """Whether a failed load would fail again: wrong settings, or files that do not fit one another."""
    return isinstance(problem, (ValueError, AnalysisException, IllegalArgumentException)) or OTHER_COLUMNS in str(problem)


def load_approved(
    wh: Warehouse,
    approvals: DataFrame,
    batch_id: int,
    formats: DataFrame | str | None = None,
    rules: Callable[[str], list[Rule]] | None = None,
) -> None:
    """Load the files approved in one micro-batch: one load per table, format and load time.

    ``formats`` is the folder of the registry of profiles, read now, or profiles. ``rules`` gives the checks of a table. What
    comes to the driver is file names, as many as a trigger lets in (``maxFilesPerTrigger`` of the approvals). Settings that
    break a rule, a file without a format, and a load that its data make impossible are errors of their workflows; any other
    failure fails the micro-batch, which is then tried again. A batch that is replayed finds its loads in the load history and
    its events (by workflow, file and load time) in the event table, and changes nothing.
    """
    known = read_registry(wh, formats) if isinstance(formats, str) else formats
    made = checked_approvals(approvals, known)
    if wh.exists(wh.main(EVENTS)):
        key = ["workflow_id", "file_path", "load_time"]
        told = wh.table(wh.main(EVENTS)).select(key).distinct().withColumn("_told", F.lit(True))
        made = made.join(told, key, "left").withColumn("_told", F.coalesce("_told", F.lit(False)))
    else:
        made = made.withColumn("_told", F.lit(False))
    keys = ["base", "mode", "load_time", "target_schema", "_refused", *[f"_{c}" for c in FORMAT_COLUMNS]]
    one = F.struct("workflow_id", "file_path", "_person", "_told")
    groups = made.groupBy(*keys).agg(F.sort_array(F.collect_set(one)).alias("approved")).orderBy("load_time", "base", "approved").collect()
    for group in groups:
        status, message, rows = ERROR, group["_refused"], 0
        if message is None:
            own = replace(wh, data_schema=group.target_schema).prepare() if group.target_schema else wh
            status, message, rows = _load_group(own, group, rules)
        now = datetime.now().isoformat(sep=" ", timespec="milliseconds")
        new = [
            (a.workflow_id, status, now, batch_id, message, rows, a.file_path, a["_person"], group.load_time)
            for a in group.approved if not a["_told"]
        ]
        if new:
            append_events(wh, local_rows(wh.spark, new, EVENT_SCHEMA))


def _load_group(wh: Warehouse, group, rules: Callable[[str], list[Rule]] | None) -> tuple[str, str | None, int]:
    """Status, message and rows of one load."""
    fmt = DelimitedFormat(**{c: group[f"_{c}"] for c in FORMAT_COLUMNS})
    files = sorted({a.file_path for a in group.approved})
    try:
        at = datetime.fromisoformat(group.load_time)
        result = load_files(wh, files, group.base, fmt, group.mode, at, rules(group.base) if rules else [])
    except Exception as problem:
        if not data_problem(problem):
            raise
        return ERROR, str(problem), 0
    if result.types:
        note_inferred(wh, files, result.types)
    if result.status in ("success", "already_loaded"):
        return COMPLETED, None, result.rows
    return ERROR, result.validation or result.status, 0


def note_inferred(wh: Warehouse, files: list[str], types: dict[str, str]) -> None:
    """Put the column types a load found into the descriptors of its files, as newer rows; files without one get none."""
    name = wh.main(DESCRIPTORS)
    if not wh.exists(name):
        return
    loaded = local_rows(wh.spark, [(f,) for f in files], "f string").select(file_key(F.col("f")).alias("path")).distinct()
    stored = newest_descriptors(wh.table(name).join(loaded, "path", "left_semi"))
    columns = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type")) for c, t in types.items()]))
    told = persist_inferred_schema(stored, stored.select("path", columns), "path", "document")
    append_events(wh, told.select("path", F.lit(datetime.now().isoformat(sep=" ", timespec="milliseconds")).alias("at"), "document"), DESCRIPTORS)


def stream_ingest(
    wh: Warehouse,
    approvals: DataFrame,
    checkpoint: str,
    once: bool = False,
    formats: DataFrame | str | None = None,
    rules: Callable[[str], list[Rule]] | None = None,
) -> StreamingQuery:
    """Load files as their approvals arrive, in the formats approved or found, behind the checks of their tables.

    Give ``formats`` as the registry's folder: a file profiled after the stream started is then loaded as it was profiled.
    """
    trigger = {"availableNow": True} if once else {"processingTime": "15 seconds"}
    return (
        approvals.writeStream.foreachBatch(lambda df, batch_id: load_approved(wh, materialize(df, "approvals"), batch_id, formats, rules))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def run_to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything there is and write it as parquet."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
