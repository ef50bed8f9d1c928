"""Snapshots, their lists and pages, and going back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.functions.times import stamp_text
from refload.operators.load import stamp_load_metadata
from refload.operators.pages import page_version_rows
from refload.operators.tables import VERSION, Warehouse, append_rows, create_table
from refload.operators.versions import (
    filter_by_version,
    list_versions,
    next_version,
    rollback_to_version,
    row_count,
    snapshot_version,
    version_counts,
    version_summary,
)
from refload.operators.workflow import post_counts
from refload.plans.catalogue import query, table
from refload.plans.queries.scans import new_warehouse

FIRST, SECOND = datetime(2024, 1, 31, 12, 0), datetime(2024, 2, 1, 12, 0)
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a backup whose versions are the years they were made in."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return orders.withColumn(VERSION, F.year("o_orderdate") - 1994)


YEARLY = "(SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) - 1994 AS INTEGER) AS ref_data_version_id FROM orders)"


def two_versions(spark: SparkSession, sf: str, label: str) -> Warehouse:
    """Orders before 1998 as version 1, all orders as version 2."""
    wh = new_warehouse(spark, label)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    rows = stamp_load_metadata(orders, FIRST, "F")
    create_table(wh, wh.main("orders"), rows.where(early).drop("o_orderdate"))
    snapshot_version(wh, "orders", FIRST)
    append_rows(wh, wh.main("orders"), rows.where(~early).drop("o_orderdate"))
    snapshot_version(wh, "orders", SECOND)
    return wh


@query(
    "snapshot_version",
    """SELECT o_orderkey, o_totalprice, v.version AS version, v.loaded AS ref_data_loadtime, 'backup' AS ref_data_loadtype
    FROM orders, (VALUES (1, '2024-01-31 12:00:00.000000'), (2, '2024-02-01 12:00:00.000000')) v(version, loaded)
    WHERE v.version = 2 OR o_orderdate < TIMESTAMP '1998-01-01'""",
)
def snapshot_version_query(spark: SparkSession, sf: str) -> DataFrame:
    backup = two_versions(spark, sf, "snapshot")
    rows = backup.table(backup.backup("orders")).withColumn("ref_data_loadtime", stamp_text(F.col("ref_data_loadtime")))
    return rows.withColumnRenamed(VERSION, "version")


@query(
    "rollback_to_version",
    "SELECT o_orderkey, o_totalprice, 'backup' AS ref_data_loadtype, 'success' AS status FROM orders "
    "WHERE o_orderdate < TIMESTAMP '1998-01-01'",
)
def rollback_to_version_query(spark: SparkSession, sf: str) -> DataFrame:
    wh = two_versions(spark, sf, "rollback")
    outcome = rollback_to_version(wh, "orders", 1)
    return wh.table(wh.main("orders")).drop("ref_data_loadtime").withColumn("status", F.lit(outcome.status))


@query("filter_by_version", f"SELECT o_orderkey, o_totalprice, ref_data_version_id AS version FROM {YEARLY} WHERE ref_data_version_id = 3")
def filter_by_version_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = filter_by_version(yearly(spark, sf), 3)
    return rows.select("o_orderkey", "o_totalprice", F.col(VERSION).alias("version"))


@query(
    "row_count",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS record_count FROM {n}" for n in NAMES)
    + f" UNION ALL SELECT 'orders version ' || ref_data_version_id, count(*) FROM {YEARLY} GROUP BY ref_data_version_id",
)
def row_count_query(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every table, and of every version of one."""
    parts = [row_count(table(spark, sf, n)).select(F.lit(n).alias("table_name"), F.col("row_count").alias("record_count")) for n in NAMES]
    name = F.concat(F.lit("orders version "), F.col(VERSION).cast("string")).alias("table_name")
    result = version_counts(yearly(spark, sf)).select(name, F.col("row_count").alias("record_count"))
    for part in parts:
        result = result.unionByName(part)
    return result


@query("next_version", f"SELECT coalesce(max(ref_data_version_id), 0) + 1 AS next_version FROM {YEARLY}")
def next_version_query(spark: SparkSession, sf: str) -> DataFrame:
    return next_version(yearly(spark, sf))


@query(
    "version_summary",
    f"SELECT count(DISTINCT ref_data_version_id) AS version_count, max(ref_data_version_id) AS latest_version FROM {YEARLY}",
)
def version_summary_query(spark: SparkSession, sf: str) -> DataFrame:
    return version_summary(yearly(spark, sf))


@query("list_versions", f"SELECT DISTINCT ref_data_version_id FROM {YEARLY} ORDER BY 1 DESC")
def list_versions_query(spark: SparkSession, sf: str) -> DataFrame:
    return list_versions(yearly(spark, sf))


PAGED = "(SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS total FROM orders)"
PAGES = (("near", 100, 150), ("far", 5000, 1000), ("over", 70, 2_000_000_000))


@query(
    "page_version_rows",
    f"""SELECT 'near' AS page, o_orderkey, o_custkey, o_totalprice, total AS total_rows, 100 AS page_limit, 150 AS page_offset FROM {PAGED}
      WHERE place BETWEEN 150 AND 249 UNION ALL SELECT 'far', o_orderkey, o_custkey, o_totalprice, total, 1000, 1000 FROM {PAGED}
      WHERE place BETWEEN 1000 AND 1999""",
)
def page_version_rows_query(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a stored version of orders: a near one, a far one that asks for too much, and one behind the end."""
    wh = new_warehouse(spark, "pages")
    create_table(wh, wh.main("orders"), table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    snapshot_version(wh, "orders", FIRST, 2)
    result = None
    for name, limit, offset in PAGES:
        page = page_version_rows(wh, "orders", 2, limit, offset)
        told = {"page": name, "total_rows": page.total, "page_limit": page.limit, "page_offset": page.offset}
        rows = page.rows.select("o_orderkey", "o_custkey", "o_totalprice").withColumns({k: F.lit(v) for k, v in told.items()})
        rows = rows.withColumns({"total_rows": F.lit(page.total).cast("long")})
        result = rows if result is None else result.unionByName(rows)
    return result


@query(
    "post_migration_counts",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS record_count FROM {n}" for n in ("orders", "lineitem", "events")
    ),
)
def post_migration_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    return post_counts({n: table(spark, sf, n) for n in ("orders", "lineitem", "events")})
