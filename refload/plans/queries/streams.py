"""Streaming forms, run until everything there is has been read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.operators.validate import in_domain, not_null, unique_key
from refload.plans.catalogue import query, table
from refload.plans.queries.scans import FILE_ROWS, bucket_of, new_warehouse
from refload.plans.queries.workflows import WORKFLOWS_SQL, workflows
from refload.session import local_rows, new_folder
from refload.sources.delimited import DelimitedFormat, write_delimited
from refload.streaming.dropfolder import dedupe_arrivals, stream_dropfolder
from refload.streaming.events import EVENTS
from refload.streaming.ingest import APPROVAL_SCHEMA, run_to_folder, stream_ingest
from refload.streaming.readiness import ready_files
from refload.streaming.stability import stream_stability
from refload.streaming.transitions import recheck_stream, transition_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables as a stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB while streams run; the session's setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """The rows a stream gives until it has read all there is."""
    spark = stream.sparkSession
    path = new_folder(spark, label)
    run_to_folder(stream, path, new_folder(spark, f"{label}-checkpoint"), mode)
    return spark.read.schema(stream.schema).parquet(path)


@query(
    "stream_dropfolder",
    """SELECT o_orderkey // 2500 AS bucket, ';' AS column_delimiter, '"' AS text_qualifier, chr(10) AS row_delimiter, 'ascii' AS encoding,
      true AS has_header, true AS has_trailer, 'TOTAL ' || count(*) AS trailer_line, 3 AS estimated_columns, CAST(count(*) + 3 AS INTEGER) AS sample_rows
    FROM orders GROUP BY 1""",
)
def stream_dropfolder_query(spark: SparkSession, sf: str) -> DataFrame:
    """Files of orders with header and trailer, dropped into a folder and profiled as they are found."""
    orders = table(spark, sf, "orders").withColumn("bucket", F.floor(F.col("o_orderkey") / FILE_ROWS))
    row = F.concat_ws(";", F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), "o_orderpriority", F.lit('"')), "o_orderstatus")
    lines = orders.select("bucket", F.col("o_orderkey").alias("k"), row.alias("value"))
    header = orders.select("bucket").distinct().select("bucket", F.lit(-1).cast("long").alias("k"), F.lit("order_id;priority;status").alias("value"))
    total = F.concat(F.lit("TOTAL "), F.count("*").cast("string")).alias("value")
    trailer = orders.groupBy("bucket").agg(total).select("bucket", F.lit(2**62).alias("k"), "value")
    folder = new_folder(spark, "drop")
    placed = header.unionByName(lines).unionByName(trailer).repartition("bucket").sortWithinPartitions("bucket", "k")
    placed.select("bucket", "value").write.partitionBy("bucket").text(folder)
    registry = new_folder(spark, "formats")
    stream_dropfolder(spark, f"{folder}/*/", registry, new_folder(spark, "drop-checkpoint"), once=True, glob="*.txt").awaitTermination()
    return spark.read.parquet(registry).select(
        bucket_of(F.col("path")).alias("bucket"),
        "column_delimiter",
        "text_qualifier",
        "row_delimiter",
        "encoding",
        "has_header",
        "has_trailer",
        "trailer_line",
        "estimated_columns",
        "sample_rows",
    )


@query(
    "stream_ingest",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, 'A' AS ref_data_loadtype, 'w0:completed,w1:completed,w2:completed,w3:error' AS status FROM customer""",
)
def stream_ingest_query(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in files of three formats, approved at two times, each loaded once; a table with a broken rule is not.

    The third kind of file is dropped and profiled after the load stream first ran, and its approval says nothing of its
    format: quotes, delimiter and trailer come from the registry, where an older profile of the same paths says otherwise.
    """
    wh = new_warehouse(spark, "streamload")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    own, other = new_folder(spark, "approved"), new_folder(spark, "approved")
    write_delimited(customers.where(F.col("c_custkey") % 3 == 0), own, DelimitedFormat())
    write_delimited(customers.where(F.col("c_custkey") % 3 == 1), other, DelimitedFormat(column_delimiter="|"))
    registry, asked, checkpoint = new_folder(spark, "formats"), new_folder(spark, "approvals"), new_folder(spark, "ingest-checkpoint")
    checks = {"customer": [not_null(1, "c_custkey"), unique_key(2, "c_custkey")], "broken": [in_domain(1, "c_mktsegment", ["none"])]}
    first, later = "2024-01-30 12:00:00", "2024-01-31 12:00:00"

    def approve(rows: list[tuple]) -> None:
        made = [(*r, *[None] * (14 - len(r))) for r in rows]
        local_rows(spark, made, APPROVAL_SCHEMA).coalesce(1).write.mode("append").json(asked)
        stream = spark.readStream.schema(APPROVAL_SCHEMA).json(asked)
        stream_ingest(wh, stream, checkpoint, True, registry, checks.__getitem__).awaitTermination()

    approve(
        [
            ("w0", own, "customer", ",", "append", first),
            ("w1", other, "customer", "|", "append", first, '"', "utf-8", True, False, 0),
            ("w3", own, "broken", ",", "append", later),
        ]
    )
    third = customers.where(F.col("c_custkey") % 3 == 2).withColumn("part", F.pmod(F.xxhash64("c_custkey"), F.lit(4)))
    row = F.concat_ws(";", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"')), "c_mktsegment")
    lines = third.select("part", F.col("c_custkey").alias("k"), row.alias("value"))
    ends = third.groupBy("part").agg(F.concat(F.lit("TOTAL;"), F.count("*").cast("string")).alias("total"))
    places = F.array(
        F.struct(F.lit(-1).cast("long").alias("k"), F.lit("c_custkey;c_name;c_mktsegment").alias("value")),
        F.struct(F.lit(2**62).alias("k"), F.col("total").alias("value")),
    )
    lines = lines.unionByName(ends.select("part", F.inline(places)))
    folder = new_folder(spark, "approved")
    lines.repartition("part").sortWithinPartitions("part", "k").select("part", "value").write.partitionBy("part").text(folder)
    stream_dropfolder(spark, f"{folder}/*/", registry, new_folder(spark, "drop-checkpoint"), once=True, glob="*.txt").awaitTermination()
    found = spark.read.parquet(registry)
    before = F.col("modificationTime") - F.expr("INTERVAL 1 DAY")
    found.drop("trigger").withColumns({"modificationTime": before, "column_delimiter": F.lit("~")}).write.parquet(f"{registry}/trigger=1000")
    paths = [r.path for r in found.select("path").distinct().collect()]
    approve([("w2", p, "customer", None, "append", later) for p in paths])
    states = wh.table(wh.main(EVENTS))
    told = F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "workflow_id", "status"))), ",")
    return wh.table(wh.main("customer")).drop("ref_data_loadtime").withColumn("status", states.agg(told).scalar())


@query(
    "ready_files",
    """WITH e AS (SELECT user_id, event_id, ts, event_type, CAST(floor(value / 80) AS BIGINT) AS size,
        last_value(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 0 END IGNORE NULLS) OVER w AS busy,
        sum(CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END) OVER w AS resets
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    looks AS (SELECT *, coalesce(lag(size) OVER w <> size OR lag(resets) OVER w <> resets, true) AS changed FROM e
      WHERE event_type IN ('view', 'click') AND coalesce(busy, 0) = 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    runs AS (SELECT *, sum(CAST(changed AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM looks),
    counted AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM runs)
    SELECT '/drop/' || user_id AS path, size, event_id AS scan_id, n AS looks FROM counted WHERE n >= 2""",
)
def ready_files_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each user as a file: views and clicks look at it, an error is its going, a purchase opens and a signup ends a workflow."""
    events = stream_table(spark, sf, "events")
    path = F.concat(F.lit("/drop/"), F.col("user_id").cast("string"))
    looks = events.where(~F.col("event_type").isin("purchase", "signup")).select(
        path.alias("path"), F.floor(F.col("value") / 80).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"),
        F.col("event_id").alias("scan_id"), F.col("ts").cast("timestamp").alias("looked_at"), (F.col("event_type") == "error").alias("gone"),
    )
    flows = stream_table(spark, sf, "events").where(F.col("event_type").isin("purchase", "signup")).select(
        path.alias("file_path"), F.when(F.col("event_type") == "signup", F.lit("completed")).otherwise(F.lit("approved")).alias("status"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"),
    )
    with rocksdb(spark):
        # Idle users are not forgotten here: the times of a year lie in one batch, whose clock moves when it is over.
        return drained(ready_files(looks, flows, wanted=2), "ready").drop("mtime")


@query(
    "stream_stability",
    """WITH scans AS (SELECT event_id, user_id, CAST(floor(value / 40) AS BIGINT) AS size, event_type IN ('view', 'click', 'purchase') AS mtime FROM events),
    marked AS (SELECT *, coalesce(lag(size) OVER w <> size OR lag(mtime) OVER w <> mtime, true) AS changed
        FROM scans WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    runs AS (SELECT *, sum(CAST(changed AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM marked)
    SELECT CAST(user_id AS VARCHAR) AS path, event_id AS scan_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS stable_count FROM runs""",
)
def stream_stability_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each user as a file that is looked at with every event, counted with state."""
    with rocksdb(spark):
        listings = stream_table(spark, sf, "events").select(
            F.col("user_id").cast("string").alias("path"),
            F.col("event_id").alias("scan_id"),
            F.floor(F.col("value") / 40).cast("double").alias("size"),
            F.col("event_type").isin("view", "click", "purchase").cast("long").alias("mtime"),
        )
        return drained(stream_stability(listings, idle_ms=None), "stability")


@query(
    "stream_transitions",
    """WITH r AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 'excel_generated' WHEN 'click' THEN 'processing'
        WHEN 'error' THEN 'error' WHEN 'signup' THEN 'approved' ELSE event_type END AS status FROM events),
    a AS (SELECT *, status <> 'purchase' AS accepted, last_value(CASE WHEN status <> 'purchase' THEN status END IGNORE NULLS) OVER w AS before,
        last_value(CASE WHEN status <> 'purchase' THEN ts END IGNORE NULLS) OVER w AS before_ts, max(ts) OVER (PARTITION BY user_id) AS last_ts
      FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    k AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM a WHERE accepted),
    m AS (SELECT max(ts) - INTERVAL 10 MINUTES AS mark FROM r)
    SELECT user_id AS workflow_id, event_id AS seq, status, coalesce(CASE WHEN before = 'processing' AND ts >= before_ts + INTERVAL 2 HOURS THEN 'error'
        ELSE before END, '') AS previous, accepted, CASE WHEN accepted THEN '' ELSE 'Invalid workflow status: purchase' END AS reason FROM a
    UNION ALL SELECT user_id, event_id, 'error', 'processing', true, 'Processing timeout after 2:00:00' FROM k, m
      WHERE status = 'processing' AND (next_ts >= ts + INTERVAL 2 HOURS OR (next_ts IS NULL AND ts + INTERVAL 2 HOURS <= greatest(mark, last_ts)))""",
)
def stream_transitions_query(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for states as a stream with state: unknown states come out refused, long processing as an error by timer."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", F.lit("excel_generated"))
        .when(kind == "click", F.lit("processing"))
        .when(kind == "signup", F.lit("approved"))
        .otherwise(kind)
    )
    asked = stream_table(spark, sf, "events").select(
        F.col("user_id").alias("workflow_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), status.alias("status")
    )
    with rocksdb(spark):
        made = drained(transition_stream(asked), "transitions")
    return made.select("workflow_id", "seq", "status", "previous", "accepted", "reason")


@query(
    "stream_recheck",
    f"""WITH newest AS (SELECT o_custkey % 2000 AS workflow_id, arg_max(o_totalprice > 250000, struct_pack(a := o_orderdate, s := o_orderkey)) AS ready
        FROM orders GROUP BY 1)
    SELECT workflow_id, CASE WHEN ready THEN 'excel_generated' ELSE 'pending_excel' END AS status FROM newest
      WHERE workflow_id IN (SELECT workflow_id FROM ({WORKFLOWS_SQL}) WHERE status IN ('pending_excel', 'excel_generated'))""",
)
def stream_recheck_query(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of settings as a stream; the newest of each pending workflow says whether its form is ready."""
    changes = stream_table(spark, sf, "orders").select(
        (F.col("o_custkey") % 2000).alias("workflow_id"),
        (F.col("o_totalprice") > 250000).alias("ready"),
        F.col("o_orderdate").alias("at"),
        F.col("o_orderkey").alias("seq"),
    )
    path = new_folder(spark, "recheck")
    recheck_stream(changes, lambda: workflows(spark, sf), path, new_folder(spark, "recheck-checkpoint"), once=True).awaitTermination()
    last = spark.read.parquet(path).groupBy("workflow_id").agg(F.max_by("status", "batch").alias("status"))
    return last.select("workflow_id", "status")


@query("dedupe_arrivals", "SELECT DISTINCT user_id AS path, event_type FROM events")
def dedupe_arrivals_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each user and kind of event as a file that arrives again and again."""
    seen = stream_table(spark, sf, "events").select(
        F.col("user_id").alias("path"),
        "event_type",
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("file"),
        F.col("ts").cast("timestamp").alias("arrived"),
    )
    return drained(dedupe_arrivals(seen, "file", "arrived", "60 days"), "arrivals").select("path", "event_type")
