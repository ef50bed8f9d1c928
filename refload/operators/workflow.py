"""File workflows: an append-only list of events and the questions asked of it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.functions.times import ntz, seconds_crossed

# Fixed values --------------------------------------------------------------------------------------
PENDING, GENERATED, REVIEWING, APPROVED = "pending_excel", "excel_generated", "user_reviewing", "approved"
PROCESSING, COMPLETED, ERROR = "processing", "completed", "error"
STATES = [PENDING, GENERATED, REVIEWING, APPROVED, PROCESSING, COMPLETED, ERROR]
# Time column set when a workflow reaches a state.
MILESTONES = {GENERATED: "excel_generated_at", APPROVED: "approved_at", COMPLETED: "completed_at"}
# Names of states in the older tracking table.
RENAMED_STATES = {"pending_pdf": PENDING, "pdf_generated": GENERATED}
# Limits: files worked on at once, hours until a run counts as stuck, retries, days kept, days shown.
MAX_RUNNING = 3
STUCK_HOURS = 2
MAX_RETRIES = 3
KEEP_DAYS = 7
RECENT_DAYS = 30
# Load settings: defaults, spellings and domains.
CONFIG_DEFAULTS = {
    "delimiter": ",",
    "text_qualifier": '"',
    "encoding": "utf-8",
    "processing_mode": "fullload",
    "table_name": "",
    "processed_by": "",
    "process_date": "",
}
CONFIG_FLAGS = {"has_headers": True, "is_reference_data": True, "confirmed": False}
DELIMITERS = [",", ";", "|", "\t"]
ENCODINGS = ["utf-8", "utf-16", "iso-8859-1", "cp1252"]
MODES = ["fullload", "append"]
TABLE_NAME = "^[A-Za-z][A-Za-z0-9_]*$"
REQUIRED = ["delimiter", "encoding", "processing_mode"]
NOT_CONFIRMED = "Final confirmation must be set to 'Yes' to proceed with processing"
BAD_MODE = "Processing mode is required. Please select 'fullload' or 'append'"
NO_TABLE = "Table name is required when 'Create Config Record' is set to Yes"
NO_PERSON = "'Processed By' field is required when processing is confirmed"
# ---------------------------------------------------------------------------------------------------


def filter_by_status(workflows: DataFrame, status: str, wanted: list[str]) -> DataFrame:
    return workflows.where(F.col(status).isin(wanted))


def pending(workflows: DataFrame, status: str = "status") -> DataFrame:
    return filter_by_status(workflows, status, [PENDING, GENERATED])


def open_workflows(workflows: DataFrame, status: str = "status") -> DataFrame:
    return workflows.where(~F.col(status).isin(COMPLETED, ERROR))


def skip_in_flight(listing: DataFrame, workflows: DataFrame, path: str, workflow_path: str) -> DataFrame:
    """Files of a listing without an open workflow; a path with many workflows is one key in the join."""
    busy = open_workflows(workflows).select(F.col(workflow_path).alias(path)).distinct()
    return listing.join(busy, path, "left_anti")


def purge_completed(
    workflows: DataFrame, as_of: datetime, days: int = KEEP_DAYS, status: str = "status", done: str = "completed_at"
) -> tuple[DataFrame, DataFrame]:
    """The workflows that stay, and the statistic that records how many went."""
    old = (F.col(status) == COMPLETED) & (F.col(done) < ntz(as_of) - F.expr(f"INTERVAL {days} DAYS"))
    gone = F.coalesce(old, F.lit(False))
    statistic = workflows.agg(F.count_if(gone).cast("decimal(10,3)").alias("stat_value")).select(
        F.lit("SYSTEM").alias("workflow_id"),
        F.lit("cleanup_operation").alias("stat_type"),
        "stat_value",
        F.lit(f"Cleaned up workflows older than {days} days").alias("additional_info"),
    )
    return workflows.where(~gone), statistic


def purge_statistics(stats: DataFrame, gone: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Statistics without those of the workflows that went; what belongs to no workflow stays."""
    return stats.join(gone.select(key).distinct(), key, "left_anti")


def recent_window_filter(rows: DataFrame, ts: str, as_of: datetime, days: int = RECENT_DAYS) -> DataFrame:
    return rows.where(F.col(ts) >= ntz(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def status_counts(workflows: DataFrame, status: str, created: str, retries: str) -> DataFrame:
    """Workflows per status that is not completed: count, oldest, newest, whole mean of retries made."""
    return (
        workflows.where(F.col(status) != COMPLETED)
        .groupBy(status)
        .agg(
            F.count("*").alias("workflow_count"),
            F.min(created).alias("oldest_workflow"),
            F.max(created).alias("newest_workflow"),
            F.avg(F.when(F.col(retries) > 0, F.col(retries))).cast("int").alias("avg_retries"),
        )
    )


def status_count_functions(spark: SparkSession, workflows: str, name: str = "workflow_status_counts") -> None:
    """Make two table functions over a table or view of workflows that SQL can call: ``name()`` and ``name_of(statuses, since)``.

    The first is ``status_counts``; the second counts the given statuses only (null: all that are not completed) of workflows
    made since a time (null: ever). They hold for the session; filters on their arguments reach the scan.
    """
    columns = "status STRING, workflow_count BIGINT, oldest_workflow TIMESTAMP, newest_workflow TIMESTAMP, avg_retries INT"
    counted = f"""SELECT status, count(*), CAST(min(created_at) AS TIMESTAMP), CAST(max(created_at) AS TIMESTAMP),
      CAST(avg(CASE WHEN retry_count > 0 THEN retry_count END) AS INT) FROM {workflows}"""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}() RETURNS TABLE ({columns}) RETURN {counted} WHERE status <> '{COMPLETED}' GROUP BY status"
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}_of(statuses ARRAY<STRING>, since TIMESTAMP) RETURNS TABLE ({columns}) RETURN {counted}
        WHERE CASE WHEN {name}_of.statuses IS NULL THEN status <> '{COMPLETED}' ELSE array_contains({name}_of.statuses, status) END
          AND ({name}_of.since IS NULL OR created_at >= {name}_of.since) GROUP BY status"""
    )


def latest_state(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Newest event per workflow, as an aggregate: each task keeps one row per workflow before the shuffle."""
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    return events.groupBy(key).agg(newest.alias("_s")).select(key, "_s.*")


def current_workflows(events: DataFrame, key: str = "workflow_id") -> DataFrame:
    """State of every workflow from its events: latest status and fields, first time, milestone times.

    A NULL field leaves the earlier value; a retry clears the error text.
    """
    order = F.struct("at", "seq")

    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)

    milestones = [F.max(F.when(F.col("status") == s, F.col("at"))).alias(c) for s, c in MILESTONES.items()]
    state = events.groupBy(key).agg(
        F.max_by("status", order).alias("status"),
        F.min("at").alias("created_at"),
        *milestones,
        F.max_by("error_message", F.when(F.col("status").isin(ERROR, PENDING), order)).alias("error_message"),
        *[last(c) for c in ("file_path", "user_config", "processed_by", "retry_count", "payload")],
        F.max("at").alias("changed_at"),
    )
    return state.withColumn("retry_count", F.coalesce("retry_count", F.lit(0)))


def workflow_durations(
    workflows: DataFrame, as_of: Column, created: str, generated: str, approved: str, completed: str, status: str
) -> DataFrame:
    """Add seconds since creation (or until completion), until the form was made and until it was approved."""
    start, form, accepted = F.col(created), F.col(generated), F.col(approved)
    end = F.when(F.col(status) == COMPLETED, F.col(completed)).otherwise(as_of)
    return workflows.withColumns(
        {
            "total_elapsed_seconds": seconds_crossed(start, end),
            "generation_seconds": seconds_crossed(start, form),
            "review_seconds": seconds_crossed(form, accepted),
        }
    )


def fifo_queue(workflows: DataFrame, status: str, ready: list[str], ts: str, key: str) -> DataFrame:
    """The next workflows to run: oldest first, as many as there are free places.

    Counting the running ones stops at the number of places.
    """
    running = workflows.where(F.col(status) == PROCESSING).limit(MAX_RUNNING).count()
    waiting = filter_by_status(workflows, status, ready)
    return waiting.orderBy(ts, key).limit(MAX_RUNNING - running)


def post_counts(named: dict[str, DataFrame]) -> DataFrame:
    """Record counts of several tables."""
    parts = [df.agg(F.count("*").alias("record_count")).withColumn("table_name", F.lit(n)) for n, df in named.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def migrate_states(old: DataFrame, status: str, renamed_columns: dict[str, str]) -> DataFrame:
    """Rows of the older tracking table under the newer names of columns and states."""
    moved = F.col(status)
    for before, after in RENAMED_STATES.items():
        moved = F.when(F.col(status) == before, F.lit(after)).otherwise(moved)
    return old.withColumn(status, moved).withColumnsRenamed(renamed_columns)


def legacy_union(legacy: DataFrame, current: DataFrame, as_of: datetime) -> DataFrame:
    """Recent rows of the older table and all rows of the newer one in one shape.

    Both have ``csv_file_path, status, created_at``; only the newer has ``form_path, workflow_id, user_config``.
    """
    old = recent_window_filter(legacy, "created_at", as_of).select(
        F.lit("legacy").alias("system_type"),
        "csv_file_path",
        "status",
        "created_at",
        F.lit("N/A").alias("processing_mode"),
    )
    new = current.select(
        F.lit("simplified").alias("system_type"),
        "csv_file_path",
        "status",
        "created_at",
        "form_path",
        "workflow_id",
        F.coalesce(F.get_json_object("user_config", "$.processing_mode"), F.lit("unknown")).alias("processing_mode"),
    )
    return new.unionByName(old, allowMissingColumns=True)


def json_config_extract(config: Column, path: str) -> Column:
    """A value out of a JSON text; NULL where the text is no JSON."""
    return F.get_json_object(F.when(F.try_parse_json(config).isNotNull(), config), path)


def canonical_load_config(form: DataFrame) -> DataFrame:
    """Settings as entered in a form, in the spelling the load uses; what was left out gets its default.

    Every setting is a text column of ``form``; texts are stripped as a form reader does.
    """
    text = {c: F.trim(F.col(c)) for c in [*CONFIG_DEFAULTS, *CONFIG_FLAGS]}
    special = {
        "delimiter": F.when(text["delimiter"] == "Tab", F.lit("\t")).otherwise(text["delimiter"]),
        "text_qualifier": F.when(text["text_qualifier"] == "None", F.lit("")).otherwise(text["text_qualifier"]),
        "processing_mode": F.when(text["processing_mode"] == "Select Mode", F.lit("")).otherwise(
            text["processing_mode"]
        ),
    }
    values = {c: F.coalesce(special.get(c, text[c]), F.lit(d)) for c, d in CONFIG_DEFAULTS.items()}
    flags = {c: F.coalesce(text[c] == "Yes", F.lit(d)) for c, d in CONFIG_FLAGS.items()}
    return form.withColumns({**values, **flags})


def validate_load_config(config: DataFrame) -> DataFrame:
    """Add ``errors`` and ``valid`` to canonical settings; every broken rule is named."""

    def c(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    confirmed = F.coalesce(F.col("confirmed"), F.lit(False))
    missing = [F.when(c(n) == "", F.lit(f"Required field missing or empty: {n}")) for n in REQUIRED]
    no_answer = F.when(F.col("confirmed").isNull(), F.lit("Required field missing or empty: confirmed"))
    rules = [
        *missing,
        no_answer,
        F.when(~confirmed, F.lit(NOT_CONFIRMED)),
        F.when(
            (c("delimiter") != "") & ~c("delimiter").isin(DELIMITERS),
            F.concat(
                F.lit("Invalid delimiter '"),
                c("delimiter"),
                F.lit("'. Valid options: comma (,), semicolon (;), pipe (|), tab"),
            ),
        ),
        F.when(
            (c("encoding") != "") & ~F.lower(c("encoding")).isin(ENCODINGS),
            F.concat(
                F.lit("Invalid encoding '"), c("encoding"), F.lit(f"'. Valid options: {', '.join(ENCODINGS)}")
            ),
        ),
        F.when(~c("processing_mode").isin(MODES), F.lit(BAD_MODE)),
        F.when(
            (c("table_name") != "") & ~c("table_name").rlike(TABLE_NAME),
            F.concat(
                F.lit("Invalid table name '"),
                c("table_name"),
                F.lit("'. Must start with letter and contain only letters, numbers, and underscores"),
            ),
        ),
        F.when(F.coalesce(F.col("is_reference_data"), F.lit(False)) & (c("table_name") == ""), F.lit(NO_TABLE)),
        F.when(confirmed & (F.trim(c("processed_by")) == ""), F.lit(NO_PERSON)),
    ]
    return config.withColumn("errors", F.array_compact(F.array(*rules))).withColumn("valid", F.size("errors") == 0)


def workflow_transitions(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests whose status exists, and those that are refused."""
    known = F.col("status").isin(STATES)
    return requests.where(known), requests.where(~known)


def timeout_stuck(state: DataFrame, as_of: datetime, hours: int = STUCK_HOURS) -> DataFrame:
    """Error events for workflows processing for too long; ``state`` has ``workflow_id, status, changed_at``."""
    stuck = (F.col("status") == PROCESSING) & (F.col("changed_at") < ntz(as_of) - F.expr(f"INTERVAL {hours} HOURS"))
    return state.where(stuck).select(
        "workflow_id",
        F.lit(ERROR).alias("status"),
        ntz(as_of).alias("at"),
        F.lit(f"Processing timeout after {hours}:00:00").alias("error_message"),
    )


def retry_failed(state: DataFrame, as_of: datetime, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Events that send failed workflows back to the start while they have retries left."""
    again = (F.col("status") == ERROR) & (F.coalesce("retry_count", F.lit(0)) < max_retries)
    return state.where(again).select(
        "workflow_id",
        F.lit(PENDING).alias("status"),
        ntz(as_of).alias("at"),
        (F.coalesce("retry_count", F.lit(0)) + 1).alias("retry_count"),
        F.lit(None).cast("string").alias("error_message"),
    )


def recheck_pending(state: DataFrame, changes: DataFrame, key: str = "workflow_id") -> DataFrame:
    """Pending workflows whose changed settings are now valid and confirmed: back to "form made".

    Settings may change often; the newest change per workflow is kept before the join.
    """
    newest = changes.groupBy(key).agg(F.max_by("ready", F.struct("at", "seq")).alias("ready"))
    ready = newest.where("ready").select(key)
    return pending(state).join(ready, key, "left_semi").select(key, F.lit(GENERATED).alias("status"))
