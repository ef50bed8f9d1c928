"""Tracking of files: states, durations, queues, purges."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.functions.times import ntz, stamp_text
from refload.operators.ordered import stable_files
from refload.operators.workflow import (
    APPROVED,
    COMPLETED,
    ERROR,
    GENERATED,
    PENDING,
    PROCESSING,
    REVIEWING,
    current_workflows,
    fifo_queue,
    latest_state,
    legacy_union,
    migrate_states,
    pending,
    purge_completed,
    purge_statistics,
    recent_window_filter,
    recheck_pending,
    retry_failed,
    skip_in_flight,
    status_count_functions,
    status_counts,
    timeout_stuck,
    workflow_durations,
    workflow_transitions,
)
from refload.plans.catalogue import query, table
from refload.plans.queries.names import pick, text
from refload.plans.queries.sqltext import sql_stamp

AS_OF = datetime(2001, 8, 1)

# Orders as workflows: seven states by key, the order's time as time of creation.
STATE_SQL = """CASE o_orderkey % 7 WHEN 0 THEN 'pending_excel' WHEN 1 THEN 'excel_generated' WHEN 2 THEN 'user_reviewing'
  WHEN 3 THEN 'approved' WHEN 4 THEN CASE WHEN o_orderkey = 4 THEN 'processing' ELSE 'error' END WHEN 5 THEN 'completed' ELSE 'error' END"""
WORKFLOWS_SQL = f"""
SELECT o_orderkey AS workflow_id, o_custkey, {STATE_SQL} AS status, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 7 = 5 THEN o_orderdate + INTERVAL 3 DAYS END AS completed_at,
  CAST(o_orderkey % 4 AS INTEGER) AS retry_count FROM orders
"""


def workflows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    fourth = F.when(key == 4, F.lit(PROCESSING)).otherwise(F.lit(ERROR))
    status = pick(
        key, F.lit(PENDING), F.lit(GENERATED), F.lit(REVIEWING), F.lit(APPROVED), fourth, F.lit(COMPLETED), F.lit(ERROR)
    )
    return table(spark, sf, "orders").select(
        key.alias("workflow_id"),
        "o_custkey",
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(key % 7 == 5, F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("completed_at"),
        (key % 4).cast("int").alias("retry_count"),
    )


@query(
    "filter_by_status",
    f"SELECT workflow_id, status FROM ({WORKFLOWS_SQL}) WHERE status IN ('pending_excel', 'excel_generated')",
)
def filter_by_status_query(spark: SparkSession, sf: str) -> DataFrame:
    return pending(workflows(spark, sf)).select("workflow_id", "status")


OLD_SQL = "status = 'completed' AND completed_at < TIMESTAMP '2001-08-01' - INTERVAL 365 DAYS"


@query(
    "purge_completed",
    f"""SELECT status AS name, CAST(count(*) AS DOUBLE) AS amount FROM ({WORKFLOWS_SQL}) WHERE NOT coalesce({OLD_SQL}, false) GROUP BY status
    UNION ALL SELECT 'cleanup_operation', CAST(count(*) AS DOUBLE) FROM ({WORKFLOWS_SQL}) WHERE {OLD_SQL}""",
)
def purge_completed_query(spark: SparkSession, sf: str) -> DataFrame:
    kept, statistic = purge_completed(workflows(spark, sf), AS_OF, 365)
    left = kept.groupBy(F.col("status").alias("name")).agg(F.count("*").cast("double").alias("amount"))
    return left.unionByName(statistic.select(F.col("stat_type").alias("name"), F.col("stat_value").cast("double").alias("amount")))


@query(
    "purge_statistics",
    f"""SELECT workflow_id, stat FROM (SELECT CAST(l_orderkey AS VARCHAR) AS workflow_id, l_linenumber AS stat FROM lineitem
        UNION ALL SELECT 'SYSTEM', o_custkey FROM orders)
      WHERE workflow_id NOT IN (SELECT CAST(workflow_id AS VARCHAR) FROM ({WORKFLOWS_SQL}) WHERE coalesce({OLD_SQL}, false))""",
)
def purge_statistics_query(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as statistics of their order's workflow, and earlier purges, which belong to no workflow."""
    stats = table(spark, sf, "lineitem").select(text("l_orderkey").alias("workflow_id"), F.col("l_linenumber").cast("long").alias("stat"))
    stats = stats.unionByName(table(spark, sf, "orders").select(F.lit("SYSTEM").alias("workflow_id"), F.col("o_custkey").alias("stat")))
    flows = workflows(spark, sf)
    kept, _ = purge_completed(flows, AS_OF, 365)
    gone = flows.join(kept.select("workflow_id"), "workflow_id", "left_anti").select(text("workflow_id").alias("workflow_id"))
    return purge_statistics(stats, gone)


@query(
    "recent_window_filter",
    f"SELECT workflow_id FROM ({WORKFLOWS_SQL}) WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAYS",
)
def recent_window_filter_query(spark: SparkSession, sf: str) -> DataFrame:
    return recent_window_filter(workflows(spark, sf), "created_at", AS_OF).select("workflow_id")


@query(
    "skip_in_flight",
    f"""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM ({WORKFLOWS_SQL}) w
      WHERE w.o_custkey = c_custkey AND status NOT IN ('completed', 'error'))""",
)
def skip_in_flight_query(spark: SparkSession, sf: str) -> DataFrame:
    listing = table(spark, sf, "customer").select("c_custkey", "c_name")
    return skip_in_flight(listing, workflows(spark, sf), "c_custkey", "o_custkey")


STATUS_COUNTS_SQL = f"""
SELECT status, count(*) AS workflow_count, {sql_stamp('min(created_at)')} AS oldest_workflow, {sql_stamp('max(created_at)')} AS newest_workflow,
  CAST(CAST(trunc(avg(CASE WHEN retry_count > 0 THEN retry_count END)) AS INTEGER) AS VARCHAR) AS avg_retries
FROM ({WORKFLOWS_SQL}) WHERE status <> 'completed' GROUP BY status
"""


@query("status_counts", STATUS_COUNTS_SQL)
def status_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    counts = status_counts(workflows(spark, sf), "status", "created_at", "retry_count")
    times = {c: stamp_text(F.col(c)) for c in ("oldest_workflow", "newest_workflow")}
    return counts.withColumns({**times, "avg_retries": F.col("avg_retries").cast("string")})


@query(
    "status_counts_tvf",
    f"""SELECT 'all' AS asked, * FROM ({STATUS_COUNTS_SQL}) UNION ALL SELECT 'some', * FROM (
      SELECT status, count(*) AS workflow_count, {sql_stamp('min(created_at)')} AS oldest_workflow, {sql_stamp('max(created_at)')} AS newest_workflow,
        CAST(CAST(trunc(avg(CASE WHEN retry_count > 0 THEN retry_count END)) AS INTEGER) AS VARCHAR) AS avg_retries
      FROM ({WORKFLOWS_SQL}) WHERE status IN ('error', 'completed') AND created_at >= TIMESTAMP '1997-01-01' GROUP BY status)""",
)
def status_counts_tvf_query(spark: SparkSession, sf: str) -> DataFrame:
    """The counts as table functions that SQL calls, without and with arguments."""
    view = f"workflows_{uuid.uuid4().hex[:8]}"
    workflows(spark, sf).createOrReplaceTempView(view)
    name = f"{view}_counts"
    status_count_functions(spark, view, name)
    found = spark.sql(
        f"""SELECT 'all' AS asked, * FROM {name}() UNION ALL
        SELECT 'some', * FROM {name}_of(array('error', 'completed'), TIMESTAMP '1997-01-01 00:00:00')"""
    )
    times = {c: stamp_text(F.col(c).cast("timestamp_ntz")) for c in ("oldest_workflow", "newest_workflow")}
    return found.withColumns({**times, "avg_retries": F.col("avg_retries").cast("string")})


@query(
    "latest_state",
    """SELECT user_id, event_id, event_type, value FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_state_query(spark: SparkSession, sf: str) -> DataFrame:
    return latest_state(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


SCANS_SQL = "SELECT event_id, user_id, ts, CAST(floor(value / 40) AS BIGINT) AS size, event_type IN ('view', 'click', 'purchase') AS mtime FROM events"


@query(
    "stable_files",
    f"""WITH marked AS (SELECT *, coalesce(lag(size) OVER w <> size OR lag(mtime) OVER w <> mtime, true) AS changed
        FROM ({SCANS_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    runs AS (SELECT *, sum(CAST(changed AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM marked),
    counted AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS stable_count FROM runs)
    SELECT event_id, user_id, stable_count, stable_count >= 6 AS is_stable FROM counted""",
)
def stable_files_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each user as a file that is looked at with every event."""
    scans = table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "ts",
        F.floor(F.col("value") / 40).alias("size"),
        F.col("event_type").isin("view", "click", "purchase").alias("mtime"),
    )
    chunk = F.to_date("ts")
    found = stable_files(scans, "user_id", ["ts", "event_id"], ["size", "mtime"], chunk)
    return found.select("event_id", "user_id", F.col("stable_count").cast("long").alias("stable_count"), "is_stable")


@query(
    "workflow_durations",
    f"""WITH shipped AS (SELECT l_orderkey, min(l_shipdate) AS form, max(l_shipdate) AS approved FROM lineitem GROUP BY l_orderkey),
    flows AS (SELECT w.*, form + INTERVAL 900 MILLISECONDS AS form, CASE WHEN workflow_id % 3 = 0 THEN approved + INTERVAL 1100 MILLISECONDS END AS approved
      FROM ({WORKFLOWS_SQL}) w LEFT JOIN shipped ON l_orderkey = workflow_id)
    SELECT workflow_id, date_diff('second', created_at, CASE WHEN status = 'completed' THEN completed_at ELSE TIMESTAMP '2001-08-01' END) AS total_elapsed_seconds,
      CAST(date_diff('second', created_at, form) AS VARCHAR) AS generation_seconds, CAST(date_diff('second', form, approved) AS VARCHAR) AS review_seconds FROM flows""",
)
def workflow_durations_query(spark: SparkSession, sf: str) -> DataFrame:
    """First and last shipment of an order as the times its form was made and approved."""
    shipped = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("workflow_id"))
        .agg(F.min("l_shipdate").alias("form"), F.max("l_shipdate").alias("approved"))
    )
    flows = workflows(spark, sf).join(shipped, "workflow_id", "left")
    flows = flows.withColumns(
        {
            "form": F.col("form") + F.expr("INTERVAL 0.9 SECONDS"),
            "approved": F.when(F.col("workflow_id") % 3 == 0, F.col("approved") + F.expr("INTERVAL 1.1 SECONDS")),
        }
    )
    timed = workflow_durations(flows, ntz(AS_OF), "created_at", "form", "approved", "completed_at", "status")
    return timed.select(
        "workflow_id", "total_elapsed_seconds", *[F.col(c).cast("string") for c in ("generation_seconds", "review_seconds")]
    )


@query(
    "fifo_queue",
    f"""SELECT workflow_id, status FROM ({WORKFLOWS_SQL}) WHERE status = 'approved' ORDER BY created_at, workflow_id
      LIMIT greatest(3 - (SELECT count(*) FROM ({WORKFLOWS_SQL}) WHERE status = 'processing'), 0)""",
)
def fifo_queue_query(spark: SparkSession, sf: str) -> DataFrame:
    return fifo_queue(workflows(spark, sf), "status", [APPROVED], "created_at", "workflow_id").select("workflow_id", "status")


@query(
    "migrate_states",
    """SELECT event_id AS workflow_id, user_id AS excel_file_path, CASE event_type WHEN 'view' THEN 'pending_excel'
      WHEN 'click' THEN 'excel_generated' ELSE event_type END AS status FROM events""",
)
def migrate_states_query(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    old = table(spark, sf, "events").select(
        F.col("event_id").alias("workflow_id"),
        F.col("user_id").alias("pdf_file_path"),
        F.when(kind == "view", F.lit("pending_pdf")).when(kind == "click", F.lit("pdf_generated")).otherwise(kind).alias("status"),
    )
    return migrate_states(old, "status", {"pdf_file_path": "excel_file_path"})


@query(
    "legacy_union",
    f"""SELECT 'legacy' AS system_type, 'f' || o_custkey AS csv_file_path, status, {sql_stamp('created_at')} AS created_at,
      CAST(NULL AS VARCHAR) AS form_path, CAST(NULL AS VARCHAR) AS workflow_id, 'N/A' AS processing_mode
    FROM ({WORKFLOWS_SQL}) WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAYS
    UNION ALL SELECT 'simplified', 'e' || user_id, event_type, {sql_stamp('ts')}, 'form' || event_id, CAST(event_id AS VARCHAR),
      CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'unknown' END FROM events""",
)
def legacy_union_query(spark: SparkSession, sf: str) -> DataFrame:
    legacy = workflows(spark, sf).withColumn("csv_file_path", F.concat(F.lit("f"), F.col("o_custkey").cast("string")))
    mode = F.concat(F.lit('{"processing_mode": "'), "event_type", F.lit('"}'))
    current = table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("csv_file_path"),
        F.col("event_type").alias("status"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("form"), F.col("event_id").cast("string")).alias("form_path"),
        F.col("event_id").cast("string").alias("workflow_id"),
        F.when(F.col("event_id") % 3 == 0, mode).otherwise(F.col("props")).alias("user_config"),
    )
    both = legacy_union(legacy, current, AS_OF)
    return both.withColumn("created_at", stamp_text(F.col("created_at")))


# Events as requests for a workflow per user; purchases ask for a state that does not exist.
REQUESTS_SQL = """
SELECT user_id AS workflow_id, event_id AS seq, ts AS happened, value, CASE event_type WHEN 'view' THEN 'excel_generated' WHEN 'click' THEN 'processing'
  WHEN 'error' THEN 'error' WHEN 'signup' THEN 'approved' ELSE 'shipped' END AS status FROM events
"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", F.lit(GENERATED))
        .when(kind == "click", F.lit(PROCESSING))
        .when(kind == "error", F.lit(ERROR))
        .when(kind == "signup", F.lit(APPROVED))
        .otherwise(F.lit("shipped"))
    )
    nothing = F.lit(None).cast("string")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("workflow_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("at"),
        status.alias("status"),
        F.when(kind == "error", F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("error_message"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".csv")).alias("file_path"),
        F.when(kind == "signup", F.col("props")).alias("user_config"),
        nothing.alias("processed_by"),
        F.when(kind == "error", (F.col("event_id") % 5).cast("int")).alias("retry_count"),
        nothing.alias("payload"),
    )


CURRENT_SQL = f"""
SELECT workflow_id, arg_max(status, struct_pack(a := happened, s := seq)) AS status, min(happened) AS created_at,
  max(happened) FILTER (WHERE status = 'excel_generated') AS excel_generated_at, max(happened) FILTER (WHERE status = 'approved') AS approved_at,
  max(happened) AS changed_at,
  coalesce(arg_max(CAST(seq % 5 AS INTEGER), struct_pack(a := happened, s := seq)) FILTER (WHERE status = 'error'), 0) AS retry_count
FROM ({REQUESTS_SQL}) WHERE status <> 'shipped' GROUP BY workflow_id
"""


@query(
    "workflow_transitions",
    f"""SELECT workflow_id, status, {sql_stamp('created_at')} AS created_at, {sql_stamp('excel_generated_at')} AS excel_generated_at,
      {sql_stamp('approved_at')} AS approved_at, retry_count FROM ({CURRENT_SQL})""",
)
def workflow_transitions_query(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with a known state, and the workflows they make."""
    accepted, _ = workflow_transitions(requests(spark, sf))
    state = current_workflows(accepted)
    times = {c: stamp_text(F.col(c)) for c in ("created_at", "excel_generated_at", "approved_at")}
    return state.withColumns(times).select("workflow_id", "status", *times, "retry_count")


STUCK_AT = datetime(2024, 1, 30, 12, 0)


@query(
    "timeout_stuck",
    f"""SELECT workflow_id, 'error' AS status, 'Processing timeout after 2:00:00' AS error_message FROM ({CURRENT_SQL})
      WHERE status = 'processing' AND changed_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 2 HOURS""",
)
def timeout_stuck_query(spark: SparkSession, sf: str) -> DataFrame:
    accepted, _ = workflow_transitions(requests(spark, sf))
    return timeout_stuck(current_workflows(accepted), STUCK_AT).drop("at")


@query(
    "retry_failed",
    f"""SELECT workflow_id, 'pending_excel' AS status, CAST(retry_count + 1 AS INTEGER) AS retry_count FROM ({CURRENT_SQL})
      WHERE status = 'error' AND retry_count < 3""",
)
def retry_failed_query(spark: SparkSession, sf: str) -> DataFrame:
    accepted, _ = workflow_transitions(requests(spark, sf))
    return retry_failed(current_workflows(accepted), STUCK_AT).select("workflow_id", "status", "retry_count")


@query(
    "recheck_pending",
    f"""WITH newest AS (SELECT o_custkey % 2000 AS workflow_id, arg_max(o_totalprice > 250000, struct_pack(a := o_orderdate, s := o_orderkey)) AS ready
        FROM orders GROUP BY 1)
    SELECT workflow_id, 'excel_generated' AS status FROM ({WORKFLOWS_SQL}) WHERE status IN ('pending_excel', 'excel_generated')
      AND workflow_id IN (SELECT workflow_id FROM newest WHERE ready)""",
)
def recheck_pending_query(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as changes of settings: the newest per workflow says whether it is ready."""
    changes = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 2000).alias("workflow_id"),
        (F.col("o_totalprice") > 250000).alias("ready"),
        F.col("o_orderdate").alias("at"),
        F.col("o_orderkey").alias("seq"),
    )
    return recheck_pending(workflows(spark, sf), changes)
