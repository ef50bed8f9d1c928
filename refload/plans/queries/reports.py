"""Reports about loads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.functions.times import stamp_text
from refload.operators.load import stamp_load_metadata
from refload.operators.registry import registry_row
from refload.operators.report import (
    backup_stats,
    collect_load_report,
    error_report,
    failed_file_report,
    load_throughput,
    recent_logs,
    sample_rows,
)
from refload.operators.tables import create_table
from refload.operators.validate import in_domain, not_null, validate_stage
from refload.operators.versions import snapshot_version
from refload.plans.catalogue import query, table
from refload.plans.queries.names import DEFAULT_ADVICE, MESSAGE_SQL, message
from refload.plans.queries.scans import new_warehouse
from refload.plans.queries.sqltext import sql_stamp
from refload.session import materialize, new_folder
from refload.sources.profiles import file_formats

AT = datetime(2024, 1, 31, 12, 0)


@query(
    "recent_logs",
    f"SELECT event_id, {sql_stamp('ts')} AS ts, event_type FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 100",
)
def recent_logs_query(spark: SparkSession, sf: str) -> DataFrame:
    newest = recent_logs(table(spark, sf, "events"), "ts", "event_id", 100)
    return newest.select("event_id", stamp_text(F.col("ts")).alias("ts"), "event_type")


@query(
    "sample_rows",
    """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN '<NULL>' ELSE p_brand END AS p_brand,
      '<binary data>' AS digest FROM part ORDER BY part.p_partkey LIMIT 5""",
)
def sample_rows_query(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(
        "p_partkey",
        "p_name",
        F.when(F.col("p_partkey") % 2 == 1, F.col("p_brand")).alias("p_brand"),
        F.encode("p_type", "UTF-8").alias("digest"),
    )
    return sample_rows(part, ["p_partkey"])


@query(
    "load_throughput",
    """SELECT event_type, count(*) AS rows, round(epoch(max(ts) - min(ts)), 3) AS seconds,
      round(count(*) / epoch(max(ts) - min(ts)), 6) AS rows_per_second FROM events GROUP BY event_type""",
)
def load_throughput_query(spark: SparkSession, sf: str) -> DataFrame:
    measured = load_throughput(table(spark, sf, "events"), "event_type", "ts", F.lit(1))
    return measured.select(
        "event_type",
        "rows",
        F.round("seconds", 3).alias("seconds"),
        F.round("rows_per_second", 6).alias("rows_per_second"),
    )


@query(
    "backup_stats",
    """SELECT 'customer' AS table_name, true AS backup_created, count(*) * 2 AS backup_rows, '2' AS versions, CAST(NULL AS VARCHAR) AS reason FROM customer
    UNION ALL SELECT 'supplier', false, 0, '0', 'Backup table not found or not created'""",
)
def backup_stats_query(spark: SparkSession, sf: str) -> DataFrame:
    wh = new_warehouse(spark, "backupstats")
    create_table(wh, wh.main("customer"), table(spark, sf, "customer"))
    snapshot_version(wh, "customer", AT)
    snapshot_version(wh, "customer", AT)
    both = backup_stats(wh, "customer").unionByName(backup_stats(wh, "supplier"))
    return both.select(
        "table_name",
        "backup_created",
        F.coalesce("backup_rows", F.lit(0)).alias("backup_rows"),
        F.coalesce(F.col("versions").cast("string"), F.lit("0")).alias("versions"),
        "reason",
    )


@query(
    "collect_load_report",
    """SELECT 'customer' AS table_name, count(*) AS backup_rows, 6 AS columns, 5 AS sample_rows,
      '{"validation_result":1,"validation_issue_list":[{"issue_id":2,"issue_detail":"c_mktsegment holds a value outside its domain"}]}' AS validation,
      'ref_customer' AS ref_name FROM customer""",
)
def collect_load_report_query(spark: SparkSession, sf: str) -> DataFrame:
    wh = new_warehouse(spark, "report")
    customers = table(spark, sf, "customer").drop("c_acctbal")
    create_table(wh, wh.main("customer"), stamp_load_metadata(customers, AT, "F"))
    snapshot_version(wh, "customer", AT)
    main = wh.table(wh.main("customer"))
    issues = validate_stage(main, [not_null(1, "c_custkey"), in_domain(2, "c_mktsegment", ["BUILDING"])])
    registry = spark.range(1).select(*registry_row(F.lit("db"), F.lit("ref"), F.lit("customer")))
    report = collect_load_report(wh, "customer", issues, registry, ["c_custkey"])
    return report.select(
        "table_name",
        "backup_rows",
        F.json_array_length("columns").alias("columns"),
        F.json_array_length("sample").alias("sample_rows"),
        "validation",
        F.get_json_object("registry", "$.ref_name").alias("ref_name"),
    )


@query(
    "error_report",
    f"""WITH tagged AS (SELECT doc_id, {MESSAGE_SQL} AS message FROM documents)
    SELECT doc_id, contains(message, 'Msg ') OR contains(message, 'Error ') AS is_database,
      CASE WHEN regexp_matches(lower(message), 'connection|database') THEN 'Check database connection settings in config.yaml'
        WHEN regexp_matches(lower(message), 'permission|access') THEN 'Verify database user has necessary permissions'
        WHEN regexp_matches(lower(message), 'column|field') THEN 'Review CSV file structure and column names'
        WHEN regexp_matches(lower(message), 'duplicate|constraint') THEN 'Check for duplicate keys in the data'
        WHEN regexp_matches(lower(message), 'encoding|character') THEN 'Try different file encoding (UTF-8, UTF-16, etc.)'
        ELSE '{DEFAULT_ADVICE[0]}' END AS first_step FROM tagged""",
)
def error_report_query(spark: SparkSession, sf: str) -> DataFrame:
    failed = table(spark, sf, "documents").select("doc_id", message().alias("message"))
    report = error_report(failed, "message")
    return report.select(
        "doc_id",
        F.array_contains("tags", "database").alias("is_database"),
        F.get("advice", F.lit(0)).alias("first_step"),
    )


FILES = 4


@query(
    "failed_file_report",
    f"""WITH f AS (SELECT o_orderkey % {FILES} AS file, count(*) AS n FROM orders GROUP BY 1)
    SELECT c_custkey, c_custkey % {FILES + 1} AS file, f.n IS NOT NULL AS profiled, CASE WHEN f.n IS NULL THEN '' ELSE ';' END AS column_delimiter,
      CASE WHEN f.n IS NULL THEN '' ELSE 'order_id,priority,status' END AS column_names, CAST(coalesce(f.n + 3, -1) AS BIGINT) AS row_count,
      'Check for duplicate keys in the data' AS first_step FROM customer LEFT JOIN f ON f.file = c_custkey % {FILES + 1}""",
)
def failed_file_report_query(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in files that are dropped and profiled; each customer is a failed load of one of them, or of a file never seen."""
    orders = table(spark, sf, "orders").withColumn("file", F.col("o_orderkey") % FILES)
    row = F.concat_ws(";", F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), "o_orderpriority", F.lit('"')), "o_orderstatus")
    lines = orders.select("file", F.col("o_orderkey").alias("k"), row.alias("value"))
    total = F.concat(F.lit("TOTAL "), F.count("*").cast("string")).alias("total")
    places = F.array(
        F.struct(F.lit(-1).cast("long").alias("k"), F.lit("order_id;priority;status").alias("value")),
        F.struct(F.lit(2**62).alias("k"), F.col("total").alias("value")),
    )
    lines = lines.unionByName(orders.groupBy("file").agg(total).select("file", F.inline(places)))
    folder = new_folder(spark, "failed")
    lines.repartition("file").sortWithinPartitions("file", "k").select("file", "value").write.partitionBy("file").text(folder)
    listing = spark.read.format("binaryFile").load(f"{folder}/*/*.txt").select("path", "modificationTime", "length")
    profiles = materialize(file_formats(spark, listing), "failed-profiles")
    number = F.regexp_extract("path", r"file=(\d+)", 1).cast("long")
    paths = profiles.select(number.alias("file"), F.col("path").alias("file_path"))
    failed = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % (FILES + 1)).alias("file")).join(paths, "file", "left")
    failed = failed.withColumns({"file_path": F.coalesce("file_path", F.lit("/nowhere.csv")), "message": F.lit("duplicate key in batch")})
    report = failed_file_report(failed, profiles, "message")
    return report.select(
        "c_custkey", "file", "profiled", F.coalesce("column_delimiter", F.lit("")).alias("column_delimiter"),
        F.coalesce(F.array_join("column_names", ","), F.lit("")).alias("column_names"), F.coalesce("row_count", F.lit(-1)).cast("long").alias("row_count"),
        F.get("advice", F.lit(0)).alias("first_step"),
    )
