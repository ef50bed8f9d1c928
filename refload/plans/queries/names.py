"""Functions of cells, names, types and texts over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.functions.cells import ALL_DIGITS, DATE_START, classify_cell
from refload.functions.errors import (
    ADVICE,
    DATABASE_MARKS,
    DEFAULT_ADVICE,
    FILE_WORDS,
    VALIDATION_WORDS,
    classify_error,
    suggest_fix,
)
from refload.functions.text import (
    FALLBACK_DATES,
    FILE_TIMESTAMPS,
    clean_null_tokens,
    rotated_table_name,
    sanitize_filename,
    sanitize_identifier,
    sanitize_words,
    table_base_name,
    table_name_fallback,
    timestamped_name,
)
from refload.functions.times import stamp_text, zone_time
from refload.functions.types import canonical_type, is_safe_widening
from refload.operators.load import project_valid_columns, stamp_load_metadata
from refload.operators.names import dedupe_headers
from refload.operators.workflow import json_config_extract
from refload.plans.catalogue import query, table
from refload.plans.queries.sqltext import sql_classify, sql_clean, sql_sanitize, sql_stamp, sql_stem

LOAD_TIME = datetime(2024, 1, 31, 12, 0, 0)


def pick(key: Column, *choices: Column) -> Column:
    """One of several columns by the remainder of a key."""
    rest = key % len(choices)
    result = F.when(rest == 0, choices[0])
    for i, choice in enumerate(choices[1:], 1):
        result = result.when(rest == i, choice)
    return result


def text(c: str) -> Column:
    return F.col(c).cast("string")


CELL_SQL = """CASE l_linenumber % 7 WHEN 0 THEN ' NULL ' WHEN 1 THEN 'NaN' WHEN 2 THEN chr(160) || 'none' || chr(9)
  WHEN 3 THEN '' WHEN 4 THEN '  ' || l_returnflag || chr(12288) WHEN 5 THEN CAST(l_orderkey AS VARCHAR)
  ELSE 'nullable ' || l_linestatus END"""


@query(
    "clean_null_tokens",
    f"SELECT l_orderkey, l_linenumber, {sql_clean('cell')} AS cleaned FROM (SELECT *, {CELL_SQL} AS cell FROM lineitem)",
)
def clean_null_tokens_query(spark: SparkSession, sf: str) -> DataFrame:
    cell = pick(
        F.col("l_linenumber"),
        F.lit(" NULL "),
        F.lit("NaN"),
        F.lit("\xa0none\t"),
        F.lit(""),
        F.concat(F.lit("  "), "l_returnflag", F.lit("　")),
        text("l_orderkey"),
        F.concat(F.lit("nullable "), "l_linestatus"),
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", clean_null_tokens(cell).alias("cleaned"))


@query(
    "project_valid_columns",
    "SELECT c_custkey AS customer_key, c_name AS col_1st_name, c_mktsegment AS segment_ FROM customer",
)
def project_valid_columns_query(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return project_valid_columns(raw.toDF("customer key", "1st-name", "  ", " segment? "))


@query(
    "stamp_load_metadata",
    "SELECT o_orderkey, o_totalprice, '2024-01-31 12:00:00.000000' AS ref_data_loadtime, 'F' AS ref_data_loadtype FROM orders",
)
def stamp_load_metadata_query(spark: SparkSession, sf: str) -> DataFrame:
    stamped = stamp_load_metadata(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), LOAD_TIME, "F")
    return stamped.withColumn("ref_data_loadtime", stamp_text(F.col("ref_data_loadtime")))


HEADER_SQL = """CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN '  ' || p_brand || ' ' WHEN 2 THEN
  CAST(p_size AS VARCHAR) || '-' || p_name WHEN 3 THEN repeat(p_type || '.', 25) ELSE '  ' END"""


@query(
    "sanitize_identifier",
    f"SELECT p_partkey, {sql_sanitize('header')} AS name FROM (SELECT p_partkey, {HEADER_SQL} AS header FROM part)",
)
def sanitize_identifier_query(spark: SparkSession, sf: str) -> DataFrame:
    header = pick(
        F.col("p_partkey"),
        F.col("p_name"),
        F.concat(F.lit("  "), "p_brand", F.lit(" ")),
        F.concat(text("p_size"), F.lit("-"), "p_name"),
        F.repeat(F.concat("p_type", F.lit(".")), 25),
        F.lit("  "),
    )
    return table(spark, sf, "part").select("p_partkey", sanitize_identifier(header).alias("name"))


FILE_SQL = """CASE o_orderkey % 9
  WHEN 0 THEN 'orders' || strftime(o_orderdate, '.%Y%m%d.%H%M%S') || '.csv'
  WHEN 1 THEN 'order-list' || strftime(o_orderdate, '_%Y%m%d_%H%M%S') || '.csv'
  WHEN 2 THEN 'orders.v' || o_custkey || strftime(o_orderdate, '.%Y%m%d%H%M%S') || '.csv'
  WHEN 3 THEN 'Çà_' || o_orderstatus || strftime(o_orderdate, '_%Y%m%d%H%M%S') || '.csv'
  WHEN 4 THEN o_custkey || strftime(o_orderdate, '.%Y%m%d') || '.CSV'
  WHEN 5 THEN o_orderpriority || strftime(o_orderdate, '_%Y%m%d') || '.csv'
  WHEN 6 THEN 'Orders ' || o_orderpriority || strftime(o_orderdate, ' %Y-%m-%d') || '.csv'
  WHEN 7 THEN '___.csv' ELSE '.hidden_' || o_orderstatus END"""


def order_file() -> Column:
    def at(pattern: str) -> Column:
        return F.date_format("o_orderdate", pattern)

    csv = F.lit(".csv")
    return pick(
        F.col("o_orderkey"),
        F.concat(F.lit("orders"), at(".yyyyMMdd.HHmmss"), csv),
        F.concat(F.lit("order-list"), at("'_'yyyyMMdd'_'HHmmss"), csv),
        F.concat(F.lit("orders.v"), text("o_custkey"), at(".yyyyMMddHHmmss"), csv),
        F.concat(F.lit("Çà_"), "o_orderstatus", at("'_'yyyyMMddHHmmss"), csv),
        F.concat(text("o_custkey"), at(".yyyyMMdd"), F.lit(".CSV")),
        F.concat("o_orderpriority", at("'_'yyyyMMdd"), csv),
        F.concat(F.lit("Orders "), "o_orderpriority", at(" yyyy-MM-dd"), csv),
        F.lit("___.csv"),
        F.concat(F.lit(".hidden_"), "o_orderstatus"),
    )


def _sql_base_name() -> str:
    name = sql_stem("file")
    for ending in FILE_TIMESTAMPS:
        name = f"regexp_replace({name}, '{ending}', '')"
    return rf"regexp_replace({name}, '[^\p{{L}}\p{{N}}_]', '_', 'g')"


@query(
    "table_base_name",
    rf"""WITH names AS (SELECT o_orderkey, {_sql_base_name()} AS name FROM (SELECT o_orderkey, {FILE_SQL} AS file FROM orders))
    SELECT o_orderkey, CASE WHEN replace(name, '_', '') = '' THEN 'unknown_table'
      WHEN regexp_matches(name, '^[\p{{L}}_]') THEN name ELSE 't_' || name END AS base FROM names""",
)
def table_base_name_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", table_base_name(order_file()).alias("base"))


def _sql_fallback() -> str:
    name = sql_stem("file")
    for date in FALLBACK_DATES:
        name = f"regexp_replace({name}, '{date}', '', 'g')"
    name = f"regexp_replace({name}, '[^a-zA-Z0-9_]', '_', 'g')"
    return f"lower(trim(regexp_replace({name}, '_+', '_', 'g'), '_'))"


@query(
    "table_name_fallback",
    f"SELECT o_orderkey, {_sql_fallback()} AS base FROM (SELECT o_orderkey, {FILE_SQL} AS file FROM orders)",
)
def table_name_fallback_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", table_name_fallback(order_file()).alias("base"))


@query(
    "sanitize_filename",
    """SELECT page_id, translate(split_part(url, '/', -1), '<>:"/\\|?*', '_________') AS filename FROM pages""",
)
def sanitize_filename_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", sanitize_filename(F.col("url")).alias("filename"))


@query(
    "timestamped_name",
    f"""WITH files AS (SELECT o_orderkey, o_orderdate, {FILE_SQL} AS file FROM orders)
    SELECT o_orderkey, {sql_stem('file')} || strftime(o_orderdate, '_%Y%m%d_%H%M%S') ||
      substr(file, length({sql_stem('file')}) + 1) AS archived,
      'orders_backup' || strftime(o_orderdate, '_%Y%m%d%H%M%S') AS rotated FROM files""",
)
def timestamped_name_query(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        timestamped_name(order_file(), at).alias("archived"),
        rotated_table_name(F.lit("orders_backup"), at).alias("rotated"),
    )


@query(
    "dedupe_names",
    f"""WITH words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word,
        generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
    named AS (SELECT doc_id, pos, {sql_sanitize('word')} AS name FROM words),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY pos) - 1 AS n FROM named)
    SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN n = 0 OR name = '' THEN name ELSE name || '_' || n END AS unique_name
    FROM numbered""",
)
def dedupe_names_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each text as a header whose words are column names."""
    texts = table(spark, sf, "documents").select("doc_id", "text")
    named = dedupe_headers(texts, "doc_id", F.split(sanitize_words(F.col("text")), " "))
    return named.select("doc_id", F.col("pos").cast("long").alias("pos"), "unique_name")


CELLS_SQL = "[CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), props, event_type, strftime(ts, '%Y-%m-%d'), strftime(ts, '%Y-%m-%d %H:%M'), ' ', '-' || user_id || '.5+']"


@query(
    "classify_cell",
    f"""WITH cells AS (SELECT event_id, unnest({CELLS_SQL}) AS cell, generate_subscripts({CELLS_SQL}, 1) AS pos FROM events)
    SELECT event_id, CAST(pos AS INTEGER) AS pos, {sql_classify('cell', ALL_DIGITS, DATE_START)} AS kind FROM cells""",
)
def classify_cell_query(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.array(
        F.col("value").cast("decimal(18,2)").cast("string"),
        "props",
        "event_type",
        F.date_format("ts", "yyyy-MM-dd"),
        F.date_format("ts", "yyyy-MM-dd HH:mm"),
        F.lit(" "),
        F.concat(F.lit("-"), text("user_id"), F.lit(".5+")),
    )
    rows = table(spark, sf, "events").select("event_id", F.posexplode(cells).alias("pos", "cell"))
    return rows.select("event_id", (F.col("pos") + 1).alias("pos"), classify_cell(F.col("cell")).alias("kind"))


TYPE_ROWS_SQL = """
SELECT l_orderkey, l_linenumber,
  CASE l_linenumber % 7 WHEN 0 THEN ' VARCHAR ' WHEN 1 THEN 'nvarchar(' || l_suppkey || ')' WHEN 2 THEN 'Decimal(' || l_suppkey || ',2)'
    WHEN 3 THEN 'varchar(MAX)' WHEN 4 THEN 'char' WHEN 5 THEN 'numeric' ELSE 'DateTime' END AS data_type,
  CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_suppkey AS INTEGER) WHEN l_orderkey % 11 = 1 THEN -1 END AS max_length,
  CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_quantity AS INTEGER) END AS numeric_precision,
  CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_linenumber AS INTEGER) END AS numeric_scale
FROM lineitem
"""


def _sql_sized(word: str) -> str:
    return (
        f"CASE WHEN max_length = -1 THEN '{word}(max)' WHEN max_length IS NOT NULL THEN '{word}(' || max_length || ')' "
        f"WHEN regexp_matches(low, '{word}\\((\\d+|max)\\)') THEN '{word}(' || regexp_extract(low, '{word}\\((\\d+|max)\\)', 1) || ')' "
        f"ELSE '{word}(4000)' END"
    )


CANONICAL_SQL = f"""
SELECT *, CASE WHEN starts_with(low, 'varchar') THEN {_sql_sized('varchar')}
  WHEN starts_with(low, 'nvarchar') THEN {_sql_sized('nvarchar')}
  WHEN starts_with(low, 'decimal') OR starts_with(low, 'numeric') THEN
    CASE WHEN numeric_precision IS NOT NULL THEN 'decimal(' || numeric_precision || ',' || numeric_scale || ')'
      WHEN regexp_matches(low, '(decimal|numeric)\\(\\d+,\\d+\\)') THEN regexp_extract(low, '(decimal|numeric)\\(\\d+,\\d+\\)')
      ELSE 'decimal(18,0)' END
  WHEN starts_with(low, 'char') THEN CASE WHEN max_length IS NOT NULL THEN 'char(' || max_length || ')' ELSE 'char(1)' END
  ELSE low END AS type
FROM (SELECT *, lower(trim(data_type)) AS low FROM ({TYPE_ROWS_SQL}))
"""


def typed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A column description per line item, with its canonical type."""
    key = F.col("l_orderkey")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        pick(
            F.col("l_linenumber"),
            F.lit(" VARCHAR "),
            F.concat(F.lit("nvarchar("), text("l_suppkey"), F.lit(")")),
            F.concat(F.lit("Decimal("), text("l_suppkey"), F.lit(",2)")),
            F.lit("varchar(MAX)"),
            F.lit("char"),
            F.lit("numeric"),
            F.lit("DateTime"),
        ).alias("data_type"),
        F.when(key % 3 == 0, F.col("l_suppkey").cast("int")).when(key % 11 == 1, F.lit(-1)).alias("max_length"),
        F.when(key % 4 == 0, F.col("l_quantity").cast("int")).alias("numeric_precision"),
        F.when(key % 4 == 0, F.col("l_linenumber").cast("int")).alias("numeric_scale"),
    )
    sizes = [F.col(c) for c in ("max_length", "numeric_precision", "numeric_scale")]
    return rows.withColumn("type", canonical_type(F.col("data_type"), *sizes))


@query("canonical_type", f"SELECT l_orderkey, l_linenumber, type FROM ({CANONICAL_SQL})")
def canonical_type_query(spark: SparkSession, sf: str) -> DataFrame:
    return typed_rows(spark, sf).select("l_orderkey", "l_linenumber", "type")


WIDER_SQL = """CASE l_linenumber % 7 WHEN 0 THEN 'varchar(50)' WHEN 1 THEN 'nvarchar(max)' WHEN 2 THEN 'decimal(18,0)'
  WHEN 3 THEN 'nvarchar(10)' WHEN 4 THEN 'varchar(40)' WHEN 5 THEN 'int' ELSE 'datetime2' END"""


@query(
    "is_safe_widening",
    f"""SELECT l_orderkey, l_linenumber, CASE
      WHEN contains(type, 'varchar') AND contains(wider, 'varchar') AND regexp_matches(type, 'varchar\\(\\d+\\)')
        AND regexp_matches(wider, 'varchar\\(\\d+\\)') THEN
        CAST(regexp_extract(wider, 'varchar\\((\\d+)\\)', 1) AS INTEGER) >= CAST(regexp_extract(type, 'varchar\\((\\d+)\\)', 1) AS INTEGER)
      WHEN contains(type, 'varchar') AND contains(wider, 'varchar') AND contains(wider, 'max') THEN true
      WHEN split_part(type, '(', 1) = split_part(wider, '(', 1) THEN true
      WHEN split_part(type, '(', 1) = 'char' THEN split_part(wider, '(', 1) IN ('varchar', 'nvarchar')
      WHEN split_part(type, '(', 1) = 'varchar' THEN split_part(wider, '(', 1) = 'nvarchar'
      WHEN split_part(type, '(', 1) = 'datetime' THEN split_part(wider, '(', 1) = 'datetime2'
      ELSE false END AS safe FROM (SELECT *, {WIDER_SQL} AS wider FROM ({CANONICAL_SQL}))""",
)
def is_safe_widening_query(spark: SparkSession, sf: str) -> DataFrame:
    wider = pick(
        F.col("l_linenumber"),
        *[F.lit(t) for t in ("varchar(50)", "nvarchar(max)", "decimal(18,0)", "nvarchar(10)", "varchar(40)", "int", "datetime2")],
    )
    safe = is_safe_widening(F.col("type"), wider)
    return typed_rows(spark, sf).select("l_orderkey", "l_linenumber", safe.alias("safe"))


MESSAGE_SQL = """CASE doc_id % 7 WHEN 0 THEN 'Msg 2627: duplicate key, constraint broken. ' WHEN 1 THEN 'Error reading file: '
  WHEN 2 THEN 'Database connection lost. ' WHEN 3 THEN 'Access to COLUMN denied. ' WHEN 4 THEN 'Bad character in CSV: '
  WHEN 5 THEN 'Foreign key validation: ' ELSE '' END || text"""


def message() -> Column:
    start = pick(
        F.col("doc_id"),
        F.lit("Msg 2627: duplicate key, constraint broken. "),
        F.lit("Error reading file: "),
        F.lit("Database connection lost. "),
        F.lit("Access to COLUMN denied. "),
        F.lit("Bad character in CSV: "),
        F.lit("Foreign key validation: "),
        F.lit(""),
    )
    return F.concat(start, "text")


def _sql_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


@query(
    "classify_error",
    f"""SELECT doc_id, concat_ws(',', CASE WHEN {_sql_any('message', DATABASE_MARKS)} THEN 'database' END,
      CASE WHEN {_sql_any('lower(message)', FILE_WORDS)} THEN 'file' END,
      CASE WHEN {_sql_any('lower(message)', VALIDATION_WORDS)} THEN 'validation' END) AS tags
    FROM (SELECT doc_id, {MESSAGE_SQL} AS message FROM documents)""",
)
def classify_error_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(classify_error(message()), ",").alias("tags"))


def _sql_texts(items: list[str]) -> str:
    return "'" + "; ".join(items).replace("'", "''") + "'"


@query(
    "suggest_fix",
    "WITH found AS (SELECT doc_id, concat_ws('; ', "
    + ", ".join(f"CASE WHEN {_sql_any('lower(message)', w)} THEN {_sql_texts(s)} END" for w, s in ADVICE)
    + f") AS advice FROM (SELECT doc_id, {MESSAGE_SQL} AS message FROM documents)) "
    + f"SELECT doc_id, CASE WHEN advice = '' THEN {_sql_texts(DEFAULT_ADVICE)} ELSE advice END AS advice FROM found",
)
def suggest_fix_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(suggest_fix(message()), "; ").alias("advice"))


@query(
    "json_config_extract",
    """WITH configs AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN substr(props, 1, 5) WHEN 1 THEN
        '{"processing_mode": "' || event_type || '", "nested": ' || props || '}' ELSE props END AS config FROM events)
    SELECT event_id, CASE WHEN json_valid(config) THEN json_extract_string(config, '$.processing_mode') END AS mode,
      CASE WHEN json_valid(config) THEN json_extract_string(config, '$.k') END AS k,
      CASE WHEN json_valid(config) THEN json_extract_string(config, '$.nested.k') END AS nested_k FROM configs""",
)
def json_config_extract_query(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = F.concat(
        F.lit('{"processing_mode": "'), "event_type", F.lit('", "nested": '), "props", F.lit("}")
    )
    config = pick(F.col("event_id"), F.substring("props", 1, 5), wrapped, F.col("props"), F.col("props"))
    rows = table(spark, sf, "events").select("event_id", config.alias("config"))
    return rows.select(
        "event_id",
        json_config_extract(F.col("config"), "$.processing_mode").alias("mode"),
        json_config_extract(F.col("config"), "$.k").alias("k"),
        json_config_extract(F.col("config"), "$.nested.k").alias("nested_k"),
    )


@query(
    "local_and_utc_time",
    f"""SELECT event_id, {sql_stamp('ts')} AS utc_time,
      {sql_stamp("(ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto'")} AS local_time FROM events""",
)
def local_and_utc_time_query(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", stamp_text(F.col("ts")).alias("utc_time"), stamp_text(zone_time(F.col("ts"))).alias("local_time")
    )
