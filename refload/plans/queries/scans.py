"""Reading files written from the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.operators.load import quarantine_write
from refload.operators.tables import Warehouse
from refload.plans.catalogue import query, table
from refload.session import materialize, new_folder
from refload.sources.delimited import (
    FILE,
    DelimitedFormat,
    drop_trailer,
    number_records,
    reject_ragged,
    scan_delimited,
    scan_records,
    skip_leading_lines,
    write_delimited,
)
from refload.sources.descriptors import read_format_descriptor, write_format_descriptor
from refload.sources.inventory import admit_files, file_inventory, size_mb
from refload.sources.logs import is_error_entry, is_ingest_entry, read_load_log, write_load_log

FILE_ROWS = 2500
FAILED_AT = datetime(2024, 1, 31, 12, 0)
PLAIN = DelimitedFormat(has_header=False)


def new_warehouse(spark: SparkSession, label: str) -> Warehouse:
    """Schemas of their own for one run."""
    root = new_folder(spark, label)
    tag = root.rsplit("-", 1)[1]
    return Warehouse(spark, root, f"ref_{tag}", f"bkp_{tag}").prepare()


def write_lines(df: DataFrame, line: Column, key: str, label: str) -> str:
    """Text files of ``FILE_ROWS`` keys each, lines in key order; returns the folder."""
    path = new_folder(df.sparkSession, label)
    lines = df.select(F.floor(F.col(key) / FILE_ROWS).alias("bucket"), F.col(key).alias("k"), line.alias("value"))
    placed = lines.repartition("bucket").sortWithinPartitions("bucket", "k").select("bucket", "value")
    placed.write.partitionBy("bucket").text(path)
    return path


def bucket_of(path: Column) -> Column:
    return F.regexp_extract(path, r"bucket=(\d+)", 1).cast("long")


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


ORDER_NAMES = ["o_orderkey", "o_orderstatus", "o_totalprice"]


def order_line() -> Column:
    return F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", money("o_totalprice"))


ORDER_SQL = (
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, "
    "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice FROM orders "
)


@query(
    "scan_delimited",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
    "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer",
)
def scan_delimited_query(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "customers")
    fmt = DelimitedFormat(column_delimiter="|", row_delimiter='|""\\r\\n')
    write_delimited(table(spark, sf, "customer").withColumn("c_acctbal", money("c_acctbal")), path, fmt)
    return scan_delimited(spark, path, fmt).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "scan_quoted_text",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents",
)
def scan_quoted_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with line breaks, delimiters and quotes survive the way through a file."""
    path = new_folder(spark, "texts")
    fmt = DelimitedFormat(column_delimiter=";", multi_line=True)
    write_delimited(table(spark, sf, "documents").select("doc_id", "text", "lang"), path, fmt)
    return scan_delimited(spark, path, fmt).select("doc_id", "text", "lang")


@query(
    "skip_leading_lines",
    ORDER_SQL + "QUALIFY row_number() OVER (PARTITION BY o_orderkey // 2500 ORDER BY o_orderkey) > 3",
)
def skip_leading_lines_query(spark: SparkSession, sf: str) -> DataFrame:
    path = write_lines(table(spark, sf, "orders"), order_line(), "o_orderkey", "skip")
    records = materialize(scan_records(spark, path, ORDER_NAMES, PLAIN), "records")
    return skip_leading_lines(number_records(records), 3).select(*ORDER_NAMES)


@query("drop_trailer", ORDER_SQL + "QUALIFY o_orderkey < max(o_orderkey) OVER (PARTITION BY o_orderkey // 2500)")
def drop_trailer_query(spark: SparkSession, sf: str) -> DataFrame:
    path = write_lines(table(spark, sf, "orders"), order_line(), "o_orderkey", "trailer")
    records = materialize(scan_records(spark, path, ORDER_NAMES, PLAIN), "records")
    return drop_trailer(records).select(*ORDER_NAMES)


RAGGED_NAMES = ["l_orderkey", "l_linenumber", "l_returnflag"]


def ragged_line() -> Column:
    """Every hundredth order has a line with a field too many, quoted delimiters do not count."""
    regular = [F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.lit('"A,B"')]
    long = (F.col("l_orderkey") % 4000 == 7) & (F.col("l_linenumber") == 1)
    short = F.col("l_discount") < 0.01
    return (
        F.when(long, F.concat_ws(",", *regular, F.lit("extra")))
        .when(short, F.concat_ws(",", *regular[:2]))
        .otherwise(F.concat_ws(",", *regular))
    )


RAGGED_CTE = """
WITH lines AS (
  SELECT l_orderkey // 2500 AS bucket,
    CASE WHEN l_orderkey % 4000 = 7 AND l_linenumber = 1 THEN 4 WHEN l_discount < 0.01 THEN 2 ELSE 3 END AS width
  FROM lineitem),
verdicts AS (
  SELECT bucket, count(*) AS records, count(*) FILTER (WHERE width > 3) AS long_records,
    count(*) FILTER (WHERE width < 3) AS short_records FROM lines GROUP BY bucket)
"""


def _ragged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    path = write_lines(table(spark, sf, "lineitem"), ragged_line(), "l_orderkey", "ragged")
    return reject_ragged(scan_records(spark, path, RAGGED_NAMES, PLAIN), PLAIN, len(RAGGED_NAMES))


@query(
    "reject_ragged",
    RAGGED_CTE
    + "SELECT bucket, records, long_records, short_records, long_records = 0 AS accepted, "
    "CASE WHEN long_records = 0 THEN records ELSE 0 END AS kept FROM verdicts",
)
def reject_ragged_query(spark: SparkSession, sf: str) -> DataFrame:
    kept, verdicts = _ragged(spark, sf)
    counted = kept.groupBy(FILE).agg(F.count("*").alias("kept"))
    return verdicts.join(counted, FILE, "left").select(
        bucket_of(F.col(FILE)).alias("bucket"),
        "records",
        "long_records",
        "short_records",
        "accepted",
        F.coalesce("kept", F.lit(0)).alias("kept"),
    )


@query(
    "quarantine_write",
    RAGGED_CTE
    + "SELECT bucket, long_records || ' records have more fields than the header' AS error, "
    "'2024-01-31 12:00:00' AS failed_at FROM verdicts WHERE long_records > 0",
)
def quarantine_write_query(spark: SparkSession, sf: str) -> DataFrame:
    _, verdicts = _ragged(spark, sf)
    wh = new_warehouse(spark, "quarantine")
    failed = verdicts.where(~F.col("accepted")).select(
        F.col(FILE).alias("file_path"),
        F.format_string("%d records have more fields than the header", "long_records").alias("error"),
        F.lit(FAILED_AT.isoformat(sep=" ")).cast("timestamp_ntz").alias("failed_at"),
    )
    quarantine_write(wh, failed)
    return wh.table(wh.main("load_errors")).select(
        bucket_of(F.col("file_path")).alias("bucket"),
        "error",
        F.date_format("failed_at", "yyyy-MM-dd HH:mm:ss").alias("failed_at"),
    )


def _descriptors(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    trailer = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("TOTAL "), F.length("html").cast("string"))).when(
        F.col("page_id") % 3 == 1, F.lit("  ")
    )
    document = write_format_descriptor(
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".csv")),
        F.lit("2024-01-31T12:00:00"),
        F.lit(";"),
        F.lit(";"),
        F.lit("\\n"),
        F.lit('"'),
        (F.col("page_id") % 4).cast("int"),
        trailer,
        F.lit("utf-8"),
    )
    return pages.select("page_id", document.alias("document"))


DESCRIPTOR_VALUES = """
SELECT page_id, 'page_' || page_id || '.csv' AS original_filename, CAST(page_id % 4 AS INTEGER) AS skip_lines,
  CASE page_id % 3 WHEN 0 THEN 'TOTAL ' || length(html) WHEN 1 THEN '  ' END AS trailer_line,
  page_id % 3 = 0 AS has_trailer
FROM pages
"""


@query(
    "write_format_descriptor",
    f"""SELECT page_id, CAST(json_object(
      'file_info', json_object('original_filename', original_filename, 'upload_timestamp', '2024-01-31T12:00:00',
        'format_version', '1.0'),
      'csv_format', json_object('header_delimiter', ';', 'column_delimiter', ';', 'row_delimiter', '\\n',
        'text_qualifier', '"', 'skip_lines', skip_lines, 'has_header', true, 'has_trailer', has_trailer,
        'trailer_line', trailer_line),
      'processing_options', json_object('encoding', 'utf-8', 'skip_blank_lines', true, 'strip_whitespace', true)
    ) AS VARCHAR) AS document FROM ({DESCRIPTOR_VALUES})""",
)
def write_format_descriptor_query(spark: SparkSession, sf: str) -> DataFrame:
    return _descriptors(spark, sf)


@query(
    "read_format_descriptor",
    f"""SELECT original_filename, ';' AS column_delimiter, skip_lines, true AS has_header, has_trailer, trailer_line,
      'utf-8' AS encoding FROM ({DESCRIPTOR_VALUES})""",
)
def read_format_descriptor_query(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "descriptors")
    _descriptors(spark, sf).select("document").write.text(path)
    # These files hold one document per line, so they are read line by line and stay splittable.
    read = read_format_descriptor(spark, path, one_per_file=False)
    return read.select(
        "file_info.original_filename",
        "csv_format.column_delimiter",
        "csv_format.skip_lines",
        "csv_format.has_header",
        "csv_format.has_trailer",
        "csv_format.trailer_line",
        "processing_options.encoding",
    )


@query(
    "file_inventory",
    """WITH files AS (
      SELECT o_orderkey // 2500 AS bucket, CAST(sum(strlen(CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus || ',' ||
        CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)) + 1) AS BIGINT) AS size_bytes
      FROM orders GROUP BY 1)
    SELECT bucket, size_bytes, CASE WHEN round(size_bytes / 1048576.0, 2) = 0 THEN 0.01
      ELSE round(size_bytes / CAST(1048576 AS DOUBLE), 2) END AS size_mb FROM files""",
)
def file_inventory_query(spark: SparkSession, sf: str) -> DataFrame:
    path = write_lines(table(spark, sf, "orders"), order_line(), "o_orderkey", "inventory")
    listing = file_inventory(spark, path, "*.txt", recursive=True)
    return listing.select(bucket_of(F.col("file_path")).alias("bucket"), "size_bytes", "size_mb")


@query(
    "admit_files",
    """WITH files AS (
      SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url ELSE url || '.CSV' END AS filename,
        CAST(length(html) AS BIGINT) * 1000 AS size_bytes FROM pages),
    sized AS (SELECT *, CASE WHEN round(size_bytes / CAST(1048576 AS DOUBLE), 2) = 0 THEN 0.01
      ELSE round(size_bytes / CAST(1048576 AS DOUBLE), 2) END AS size_mb FROM files)
    SELECT page_id, concat_ws('; ',
      CASE WHEN size_bytes > 2097152 THEN 'File size (' || CAST(size_mb AS VARCHAR) ||
        ' MB) exceeds maximum limit (2.0 MB)' END,
      CASE WHEN NOT ends_with(lower(filename), '.csv') THEN 'File must have .csv extension' END) AS errors,
      size_bytes <= 2097152 AND ends_with(lower(filename), '.csv') AS valid FROM sized""",
)
def admit_files_query(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(F.concat("url", F.lit(".CSV"))).alias("filename"),
        (F.length("html") * F.lit(1000).cast("long")).alias("size_bytes"),
    )
    listed = files.withColumn("size_mb", size_mb(F.col("size_bytes")))
    return admit_files(listed, 2 * 1024 * 1024).select("page_id", F.concat_ws("; ", "errors").alias("errors"), "valid")


def _log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log lines; clicks are broken off in the middle of the line."""
    events = table(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO"))
    step = F.when(F.col("event_type") == "purchase", F.lit("Upload_file")).otherwise(F.col("event_type"))
    entry = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            level.alias("level"),
            step.alias("action_step"),
            F.concat(F.lit('said "'), F.col("event_id").cast("string"), F.lit('"')).alias("message"),
            F.create_map(
                F.lit("filename"),
                F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".csv")),
                F.lit("table_name"),
                F.concat(F.lit("t"), F.col("user_id").cast("string")),
                F.lit("row_count"),
                F.col("event_id").cast("string"),
            ).alias("metadata"),
        )
    )
    broken = F.when(F.col("event_type") == "click", F.substring(entry, 1, 60)).otherwise(entry)
    return events.select(broken.alias("value"))


LOG_SQL = """
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  CASE event_type WHEN 'purchase' THEN 'Upload_file' ELSE event_type END AS action_step,
  'said "' || event_id || '"' AS message, 'f' || user_id || '.csv' AS file_name, 't' || user_id AS table_name,
  CAST(event_id AS INTEGER) AS row_count
FROM events WHERE event_type <> 'click'
"""


@query("read_load_log", f"SELECT timestamp, level, action_step, message FROM ({LOG_SQL})")
def read_load_log_query(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "log")
    _log_lines(spark, sf).write.text(path)
    return read_load_log(spark, path).select("timestamp", "level", "action_step", "message")


@query(
    "write_load_log",
    f"SELECT *, level = 'ERROR' AS is_error, action_step = 'Upload_file' AS is_ingest FROM ({LOG_SQL})",
)
def write_load_log_query(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "log")
    _log_lines(spark, sf).write.text(path)
    wh = new_warehouse(spark, "log")
    write_load_log(read_load_log(spark, path), wh.main("system_log"))
    log = wh.table(wh.main("system_log"))
    return log.select(
        "timestamp",
        "level",
        "action_step",
        "message",
        "file_name",
        "table_name",
        "row_count",
        is_error_entry(F.col("level")).alias("is_error"),
        is_ingest_entry(F.col("action_step")).alias("is_ingest"),
    )
