"""Load logs: JSON lines in, a log table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a log line and the steps that belong to the ingest log.
LOG_SCHEMA = (
    "timestamp string, timestamp_local string, tz string, level string, action_step string, message string,"
    "source_ip string, traceback string, metadata map<string,string>"
)
INGEST_WORDS = ["ingest", "upload", "import", "process_file", "validate"]


def read_load_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as rows; lines that are no JSON are skipped."""
    bad = "_bad_line"
    lines = spark.read.text(path)
    parsed = F.from_json("value", f"{LOG_SCHEMA}, {bad} string", {"columnNameOfCorruptRecord": bad})
    rows = lines.withColumn("entry", parsed).where((F.trim("value") != "") & F.col(f"entry.{bad}").isNull())
    return rows.select("entry.*").drop(bad)


def is_error_entry(level: Column) -> Column:
    return level == "ERROR"


def is_ingest_entry(action_step: Column) -> Column:
    return F.lower(action_step).rlike("|".join(INGEST_WORDS))


def log_records(entries: DataFrame) -> DataFrame:
    """Shape of the log table: file, table and row count come out of the metadata."""
    meta = F.col("metadata")
    return entries.select(
        "timestamp",
        "level",
        "action_step",
        "message",
        "source_ip",
        F.col("traceback").alias("error_traceback"),
        meta["filename"].alias("file_name"),
        meta["table_name"].alias("table_name"),
        meta["row_count"].try_cast("int").alias("row_count"),
        F.when(F.size(meta) > 0, F.to_json(meta)).alias("metadata"),
    )


def write_load_log(entries: DataFrame, table: str) -> None:
    """Append entries to the log table, making it if need be."""
    log_records(entries).write.mode("append").format("parquet").saveAsTable(table)
