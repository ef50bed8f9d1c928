"""Reports: what a load did, how fast, and what its table looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refload.functions.errors import classify_error, suggest_fix
from refload.functions.text import file_key
from refload.operators.evolve import describe_table
from refload.operators.tables import Warehouse
from refload.operators.validate import validation_json
from refload.operators.versions import stored_versions
from refload.session import local_rows

# Rows shown and how they show what is no text.
SAMPLE_ROWS = 5
NULL_TEXT, BINARY_TEXT = "<NULL>", "<binary data>"


def display(df: DataFrame, column: str) -> Column:
    """A cell as shown in a report."""
    if dict(df.dtypes)[column] == "binary":
        return F.when(F.col(column).isNull(), F.lit(NULL_TEXT)).otherwise(F.lit(BINARY_TEXT))
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL_TEXT))


def sample_rows(df: DataFrame, order: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows as text."""
    head = df.orderBy(*order).limit(rows)
    return head.select(*[display(df, c).alias(c) for c in df.columns])


def recent_logs(logs: DataFrame, ts: str, key: str, limit: int = 100) -> DataFrame:
    """Newest log records first: a top-n, not a sort of the log."""
    return logs.orderBy(F.desc(ts), F.desc(key)).limit(limit)


def load_throughput(log: DataFrame, phase: str, ts: str, rows: Column) -> DataFrame:
    """Rows, seconds and rows per second of each phase."""
    micros = F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts))
    sums = log.groupBy(phase).agg(F.sum(rows).cast("long").alias("rows"), (micros / 1e6).alias("seconds"))
    rate = F.when(F.col("seconds") > 0, F.col("rows") / F.col("seconds")).otherwise(F.lit(0.0))
    return sums.withColumn("rows_per_second", rate)


def backup_stats(wh: Warehouse, base: str) -> DataFrame:
    """Whether a table has a backup, and how many rows and versions it holds."""
    spark, name = wh.spark, wh.backup(base)
    if not wh.exists(name):
        reason = "Backup table not found or not created"
        return local_rows(spark, 
            [(base, False, None, None, None, reason)],
            "table_name string, backup_created boolean, backup_table string, versions int, backup_rows long, reason string",
        )
    return (
        wh.table(name)
        .agg(F.count("*").alias("backup_rows"))
        .select(
            F.lit(base).alias("table_name"),
            F.lit(True).alias("backup_created"),
            F.lit(name).alias("backup_table"),
            F.lit(len(stored_versions(wh, base))).alias("versions"),
            "backup_rows",
            F.lit(None).cast("string").alias("reason"),
        )
    )


def collect_load_report(wh: Warehouse, base: str, issues: DataFrame, registry: DataFrame, order: list[str]) -> DataFrame:
    """One row about a load: columns, backup, checks, registry entry and first rows, all as JSON.

    Every part is a single value, so none is joined.
    """
    main = wh.table(wh.main(base))
    columns = describe_table(wh.spark, main).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("position", "name", "data_type", "max_length"))))
    )
    sample = sample_rows(main, order)
    shown = sample.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*sample.columns)))))
    entry = registry.where(F.col("source_table") == base).agg(F.max(F.to_json(F.struct(*registry.columns))))
    return backup_stats(wh, base).withColumns(
        {
            "columns": columns.scalar(),
            "sample": shown.scalar(),
            "validation": validation_json(issues).scalar(),
            "registry": entry.scalar(),
        }
    )


def error_report(errors: DataFrame, message: str) -> DataFrame:
    """Failed loads with the tags of their error and the advice for it."""
    return errors.withColumns({"tags": classify_error(F.col(message)), "advice": suggest_fix(F.col(message))})


def failed_file_report(errors: DataFrame, profiles: DataFrame, message: str, path: str = "file_path", at: str | None = None) -> DataFrame:
    """Failed loads with what is known of their file: format, columns, rows, size, first fields, beside tags and advice.

    ``profiles`` is the registry of profiled files. A file is described by its newest profile, with ``at`` (the time of the failure)
    by the newest not after it. A file that was never profiled has a row all the same, with ``profiled`` false. Profiles are cut to
    one a failure by an aggregate before they meet the report.
    """
    order = [c for c in ("modificationTime", "trigger") if c in profiles.columns]
    told = F.struct(
        F.col("length").alias("file_size"), F.col("modificationTime").alias("file_modified"), F.col("estimated_columns").alias("detected_columns"),
        F.col("sample_rows").alias("row_count"), F.get("sample_data", F.lit(0)).alias("column_names"), "column_delimiter", "text_qualifier",
        "encoding", "has_header", "has_trailer", F.col("error").alias("read_error"),
    )
    found = profiles.select(file_key(F.col("path")).alias("_key"), told.alias("_told"), F.struct(*order).alias("_order"))
    failed = errors.withColumns({"_key": file_key(F.col(path)), "_at": F.col(at).cast("timestamp") if at else F.lit(None).cast("timestamp")})
    met = failed.select("_key", "_at").distinct().join(found, "_key")
    met = met.where(F.col("_at").isNull() | (F.col("_order.modificationTime") <= F.col("_at")))
    newest = met.groupBy("_key", "_at").agg(F.max_by("_told", "_order").alias("_told"))
    newest = newest.select(F.col("_key").alias("_of"), F.col("_at").alias("_until"), "_told")
    joined = failed.join(newest, (F.col("_key") == F.col("_of")) & F.col("_at").eqNullSafe(F.col("_until")), "left")
    joined = joined.select(*errors.columns, F.col("_told").isNotNull().alias("profiled"), "_told.*")
    return error_report(joined, message)
