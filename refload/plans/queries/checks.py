"""Validation of rows and of load settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.operators.validate import (
    Rule,
    foreign_key,
    in_domain,
    matches,
    max_length,
    not_null,
    predicate,
    unique_key,
    validate_stage,
    validation_json,
)
from refload.operators.workflow import canonical_load_config, validate_load_config
from refload.plans.catalogue import query, table
from refload.plans.queries.names import pick, text


def line_rules(spark: SparkSession, sf: str) -> list[Rule]:
    """Checks of line items; the parent table lacks some orders."""
    orders = table(spark, sf, "orders").where("o_orderkey % 97 <> 5")
    return [
        not_null(1, "l_partkey"),
        in_domain(2, "l_returnflag", ["A", "N"]),
        max_length(3, "l_linestatus", 0),
        matches(4, "l_returnflag", "^[AR]$"),
        predicate(5, "l_quantity must be below 50", F.col("l_quantity") >= 50),
        unique_key(6, "l_orderkey", "l_linenumber"),
        unique_key(7, "l_orderkey", "l_suppkey"),
        foreign_key(8, "l_orderkey", orders, "o_orderkey"),
    ]


ISSUES_SQL = """
SELECT 1 AS issue_id, 'l_partkey must not be empty' AS issue_detail, count(*) FILTER (WHERE l_partkey IS NULL) AS rows FROM lineitem
UNION ALL SELECT 2, 'l_returnflag holds a value outside its domain', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem
UNION ALL SELECT 3, 'l_linestatus is longer than 0', count(*) FILTER (WHERE length(l_linestatus) > 0) FROM lineitem
UNION ALL SELECT 4, 'l_returnflag does not match ^[AR]$', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R')) FROM lineitem
UNION ALL SELECT 5, 'l_quantity must be below 50', count(*) FILTER (WHERE l_quantity >= 50) FROM lineitem
UNION ALL SELECT 6, 'l_orderkey, l_linenumber must be unique', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL SELECT 7, 'l_orderkey, l_suppkey must be unique', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey)
UNION ALL SELECT 8, 'l_orderkey has no parent', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 5)
"""


@query("validate_stage", ISSUES_SQL)
def validate_stage_query(spark: SparkSession, sf: str) -> DataFrame:
    return validate_stage(table(spark, sf, "lineitem"), line_rules(spark, sf))


@query(
    "validation_json",
    f"""SELECT '{{"validation_result":' || count(*) || ',"validation_issue_list":[' ||
      string_agg('{{"issue_id":' || issue_id || ',"issue_detail":"' || issue_detail || '"}}', ',' ORDER BY issue_id) || ']}}' AS validation
    FROM ({ISSUES_SQL}) WHERE rows > 0""",
)
def validation_json_query(spark: SparkSession, sf: str) -> DataFrame:
    return validation_json(validate_stage(table(spark, sf, "lineitem"), line_rules(spark, sf)))


@query(
    "validate_labels",
    """SELECT 1 AS issue_id, 'doc_id has no parent' AS issue_detail, count(*) AS rows FROM labels WHERE doc_id NOT IN
      (SELECT doc_id FROM documents WHERE lang <> 'en')
    UNION ALL SELECT 2, 'doc_id must be unique', CAST(count(*) - count(DISTINCT doc_id) AS BIGINT) FROM labels
    UNION ALL SELECT 3, 'quality holds a value outside its domain', count(*) FILTER (WHERE quality NOT IN (0, 1)) FROM labels""",
)
def validate_labels_query(spark: SparkSession, sf: str) -> DataFrame:
    foreign = table(spark, sf, "documents").where("lang <> 'en'")
    rules = [foreign_key(1, "doc_id", foreign, "doc_id"), unique_key(2, "doc_id"), in_domain(3, "quality", [0, 1])]
    return validate_stage(table(spark, sf, "labels"), rules)


FORM_SQL = """
SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN 'Tab' WHEN 1 THEN ' , ' WHEN 2 THEN '#' WHEN 3 THEN '|' END AS delimiter,
  CASE o_orderkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN '"' END AS text_qualifier,
  CASE o_orderkey % 6 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'latin-9' WHEN 2 THEN 'cp1252' END AS encoding,
  CASE o_orderkey % 7 WHEN 0 THEN 'Select Mode' WHEN 1 THEN 'append' WHEN 2 THEN 'fullload ' WHEN 3 THEN 'merge' END AS processing_mode,
  CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'orders_' || o_orderkey END AS table_name,
  CASE o_orderkey % 8 WHEN 0 THEN ' ' WHEN 1 THEN 'clerk ' || o_custkey WHEN 2 THEN 'x' END AS processed_by,
  strftime(o_orderdate, '%Y-%m-%d') AS process_date,
  CASE o_orderkey % 2 WHEN 0 THEN 'Yes' END AS has_headers,
  CASE o_orderkey % 9 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS is_reference_data,
  CASE o_orderkey % 11 WHEN 0 THEN 'No' WHEN 1 THEN NULL ELSE ' Yes' END AS confirmed
FROM orders
"""

CANONICAL_FORM_SQL = f"""
SELECT o_orderkey,
  coalesce(CASE WHEN trim(delimiter) = 'Tab' THEN chr(9) ELSE trim(delimiter) END, ',') AS delimiter,
  coalesce(CASE WHEN trim(text_qualifier) = 'None' THEN '' ELSE trim(text_qualifier) END, '"') AS text_qualifier,
  coalesce(trim(encoding), 'utf-8') AS encoding,
  coalesce(CASE WHEN trim(processing_mode) = 'Select Mode' THEN '' ELSE trim(processing_mode) END, 'fullload') AS processing_mode,
  coalesce(trim(table_name), '') AS table_name, coalesce(trim(processed_by), '') AS processed_by,
  coalesce(trim(process_date), '') AS process_date,
  coalesce(trim(has_headers) = 'Yes', true) AS has_headers, coalesce(trim(is_reference_data) = 'Yes', true) AS is_reference_data,
  coalesce(trim(confirmed) = 'Yes', false) AS confirmed
FROM ({FORM_SQL})
"""


def forms(spark: SparkSession, sf: str) -> DataFrame:
    """A filled-in form per order; NULL where nothing was entered."""
    key = F.col("o_orderkey")

    def entry(size: int, **texts: F.Column | str) -> F.Column:
        result = F.when(F.lit(False), F.lit(""))
        for rest, value in texts.items():
            result = result.when(key % size == int(rest[1:]), F.lit(value) if isinstance(value, str) else value)
        return result

    order = text("o_orderkey")
    confirmed = pick(key % 11, F.lit("No"), F.lit(None), *[F.lit(" Yes")] * 9)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        entry(5, _0="Tab", _1=" , ", _2="#", _3="|").alias("delimiter"),
        entry(4, _0="None", _1='"').alias("text_qualifier"),
        entry(6, _0="UTF-8", _1="latin-9", _2="cp1252").alias("encoding"),
        entry(7, _0="Select Mode", _1="append", _2="fullload ", _3="merge").alias("processing_mode"),
        entry(3, _0=F.col("o_orderpriority"), _1=F.concat(F.lit("orders_"), order)).alias("table_name"),
        entry(8, _0=" ", _1=F.concat(F.lit("clerk "), text("o_custkey")), _2="x").alias("processed_by"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("process_date"),
        entry(2, _0="Yes").alias("has_headers"),
        entry(9, _0="No", _1="Yes").alias("is_reference_data"),
        confirmed.alias("confirmed"),
    )


@query("canonical_load_config", CANONICAL_FORM_SQL)
def canonical_load_config_query(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_load_config(forms(spark, sf))


@query(
    "validate_load_config",
    f"""SELECT o_orderkey, concat_ws('; ',
      CASE WHEN delimiter = '' THEN 'Required field missing or empty: delimiter' END,
      CASE WHEN encoding = '' THEN 'Required field missing or empty: encoding' END,
      CASE WHEN processing_mode = '' THEN 'Required field missing or empty: processing_mode' END,
      CASE WHEN NOT confirmed THEN 'Final confirmation must be set to ''Yes'' to proceed with processing' END,
      CASE WHEN delimiter <> '' AND delimiter NOT IN (',', ';', '|', chr(9)) THEN 'Invalid delimiter ''' || delimiter ||
        '''. Valid options: comma (,), semicolon (;), pipe (|), tab' END,
      CASE WHEN encoding <> '' AND lower(encoding) NOT IN ('utf-8', 'utf-16', 'iso-8859-1', 'cp1252') THEN 'Invalid encoding ''' || encoding ||
        '''. Valid options: utf-8, utf-16, iso-8859-1, cp1252' END,
      CASE WHEN processing_mode NOT IN ('fullload', 'append') THEN 'Processing mode is required. Please select ''fullload'' or ''append''' END,
      CASE WHEN table_name <> '' AND NOT regexp_matches(table_name, '^[A-Za-z][A-Za-z0-9_]*$') THEN 'Invalid table name ''' || table_name ||
        '''. Must start with letter and contain only letters, numbers, and underscores' END,
      CASE WHEN is_reference_data AND table_name = '' THEN 'Table name is required when ''Create Config Record'' is set to Yes' END,
      CASE WHEN confirmed AND trim(processed_by) = '' THEN '''Processed By'' field is required when processing is confirmed' END) AS errors
    FROM ({CANONICAL_FORM_SQL})""",
)
def validate_load_config_query(spark: SparkSession, sf: str) -> DataFrame:
    checked = validate_load_config(canonical_load_config(forms(spark, sf)))
    return checked.select("o_orderkey", F.array_join("errors", "; ").alias("errors"))
