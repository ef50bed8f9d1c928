"""Staging, full and append loads, and whole batch loads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.functions.times import stamp_text
from refload.operators.load import (
    align_columns,
    append_load,
    dominant_load_type,
    full_load,
    load_type_by_key,
    stage_load,
    stamp_load_metadata,
)
from refload.operators.tables import create_table, replace_rows
from refload.operators.validate import matches, not_null
from refload.plans.batch_load import load_files
from refload.plans.catalogue import query, table
from refload.plans.queries.scans import new_warehouse
from refload.session import new_folder
from refload.sources.delimited import DelimitedFormat, write_delimited

FIRST, SECOND = datetime(2024, 1, 31, 12, 0), datetime(2024, 2, 1, 12, 0)
HALF = datetime(1998, 1, 1)


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers with even keys as a main table; those with odd keys as a stage with a column more."""
    suppliers = table(spark, sf, "supplier")
    even = suppliers.where(F.col("s_suppkey") % 2 == 0)
    odd = suppliers.where(F.col("s_suppkey") % 2 == 1).withColumn("S_Note", F.concat(F.lit("note "), "s_name"))
    return stamp_load_metadata(even, FIRST, "F"), stamp_load_metadata(odd.drop("s_acctbal"), SECOND, "A")


@query(
    "stage_load",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END AS c_name,
      c_mktsegment, '2024-01-31 12:00:00.000000' AS ref_data_loadtime, 'F' AS ref_data_loadtype FROM customer""",
)
def stage_load_query(spark: SparkSession, sf: str) -> DataFrame:
    wh = new_warehouse(spark, "stage")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit(" none ")).otherwise(F.concat(F.lit(" "), "c_name")).alias("c_name"),
        "c_mktsegment",
    )
    stage = stage_load(wh, "customer", rows, FIRST, "F")
    return stage.withColumn("ref_data_loadtime", stamp_text(F.col("ref_data_loadtime")))


@query(
    "align_columns",
    """SELECT s_suppkey, s_name, s_nationkey, CAST(NULL AS DOUBLE) AS s_acctbal,
      'S_Note' AS skipped, 's_acctbal' AS defaulted FROM supplier WHERE s_suppkey % 2 = 1""",
)
def align_columns_query(spark: SparkSession, sf: str) -> DataFrame:
    main, stage = halves(spark, sf)
    found = align_columns(stage, main)
    aligned = full_load(main, stage).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return aligned.withColumns(
        {"skipped": F.lit(",".join(found.skipped)), "defaulted": F.lit(",".join(found.defaulted))}
    )


@query(
    "append_load",
    """SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal,
      CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'A' END AS ref_data_loadtype FROM supplier""",
)
def append_load_query(spark: SparkSession, sf: str) -> DataFrame:
    return append_load(*halves(spark, sf)).drop("ref_data_loadtime")


@query(
    "full_load",
    """SELECT s_suppkey, s_name, s_nationkey, CAST(NULL AS DOUBLE) AS s_acctbal, 'A' AS ref_data_loadtype
      FROM supplier WHERE s_suppkey % 2 = 1""",
)
def full_load_query(spark: SparkSession, sf: str) -> DataFrame:
    """The main table is replaced in the catalogue and read back."""
    wh = new_warehouse(spark, "full")
    main, stage = halves(spark, sf)
    create_table(wh, wh.main("supplier"), main)
    replace_rows(wh, wh.main("supplier"), full_load(wh.table(wh.main("supplier")), stage))
    return wh.table(wh.main("supplier")).drop("ref_data_loadtime")


@query(
    "determine_load_type",
    """WITH typed AS (SELECT user_id, CASE event_type WHEN 'view' THEN CASE WHEN user_id % 3 = 0 THEN ' f ' END
        WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'a' END WHEN 'error' THEN 'backup' END AS t FROM events)
    SELECT user_id, CASE WHEN bool_or(upper(trim(t)) = 'F') THEN 'F' WHEN bool_or(upper(trim(t)) = 'A') THEN 'A'
      ELSE 'F' END AS load_type FROM typed GROUP BY user_id""",
)
def determine_load_type_query(spark: SparkSession, sf: str) -> DataFrame:
    user, kind = F.col("user_id"), F.col("event_type")
    stored = (
        F.when((kind == "view") & (user % 3 == 0), F.lit(" f "))
        .when((kind == "click") & (user % 2 == 0), F.lit("a"))
        .when(kind == "error", F.lit("backup"))
    )
    rows = table(spark, sf, "events").select("user_id", stored.alias("stored"))
    return load_type_by_key(rows, ["user_id"], "stored", "fullload")


@query(
    "dominant_load_type",
    """WITH typed AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'F' WHEN 'click' THEN 'append'
        WHEN 'error' THEN 'backup' END AS t FROM events),
    latest AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
      FROM typed WHERE t IS NOT NULL)
    SELECT user_id, CASE t WHEN 'append' THEN 'append' ELSE 'fullload' END AS default_mode FROM latest WHERE n = 1""",
)
def dominant_load_type_query(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    stored = (
        F.when(kind == "view", F.lit("F")).when(kind == "click", F.lit("append")).when(kind == "error", F.lit("backup"))
    )
    rows = table(spark, sf, "events").withColumn("stored", stored)
    order = F.struct("ts", "event_id").alias("at")
    return dominant_load_type(rows, "stored", order, ["user_id"])


def order_text(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as they would stand in a file."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit("nan")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        "o_orderdate",
    )


def load_two_batches(spark: SparkSession, sf: str, second_mode: str, label: str):
    """Orders before 1998 as a first batch, the others as a second one; returns warehouse and results."""
    wh = new_warehouse(spark, label)
    fmt = DelimitedFormat(column_delimiter=";")
    orders = order_text(spark, sf)
    early = F.col("o_orderdate") < F.lit(HALF.isoformat(sep=" ")).cast("timestamp_ntz")
    results = []
    for part, mode, at in ((early, "fullload", FIRST), (~early, second_mode, SECOND)):
        path = new_folder(spark, "batch")
        write_delimited(orders.where(part).drop("o_orderdate"), path, fmt)
        rules = [not_null(1, "o_orderkey"), matches(2, "o_totalprice", r"^\d+\.\d\d$")]
        override = "A" if mode == "append" else None
        results.append(load_files(wh, path, "orders", fmt, mode, at, rules, override))
    return wh, results


@query(
    "batch_load",
    """WITH batches AS (SELECT 1 AS version, * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
      UNION ALL SELECT 2 AS version, * FROM orders)
    SELECT version, count(*) AS row_count, count(*) FILTER (WHERE o_orderkey % 50 <> 0) AS priorities,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM batches GROUP BY version""",
)
def batch_load_query(spark: SparkSession, sf: str) -> DataFrame:
    """Two files of orders loaded one after the other; rows and sums of both versions."""
    wh, _ = load_two_batches(spark, sf, "append", "batchload")
    backup = wh.table(wh.backup("orders"))
    return backup.groupBy(F.col("ref_data_version_id").alias("version")).agg(
        F.count("*").alias("row_count"),
        F.count("o_orderpriority").alias("priorities"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
    )


@query(
    "batch_load_rows",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
      CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice,
      CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
      '2024-02-01 12:00:00.000000' AS ref_data_loadtime, 'F' AS ref_data_loadtype
    FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""",
)
def batch_load_rows_query(spark: SparkSession, sf: str) -> DataFrame:
    """The main table after a second full load, which replaced the first."""
    wh, _ = load_two_batches(spark, sf, "fullload", "fullrows")
    return wh.table(wh.main("orders")).withColumn("ref_data_loadtime", stamp_text(F.col("ref_data_loadtime")))
