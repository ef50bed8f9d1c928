"""Catalog tables of a load: parquet folders that are replaced by pointing the table at a new folder.

File tables know no UPDATE and cannot overwrite what they read. A replacement is written beside the old
data and becomes visible with one ``SET LOCATION``, so readers see the old rows or the new ones and a lost
job leaves the table as it was.
"""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the metadata columns and tables, and what a table name may look like.
LOAD_TIME, LOAD_TYPE, VERSION = "ref_data_loadtime", "ref_data_loadtype", "ref_data_version_id"
LOAD_COLUMNS = {LOAD_TIME: "datetime", LOAD_TYPE: "varchar(255)"}
STAGE_SUFFIX, BACKUP_SUFFIX = "_stage", "_backup"
#: Option of tables whose rows may lie in folders within their folder.
NESTED = "recursiveFileLookup"
BASE_NAME = re.compile(r"^[A-Za-z0-9_]+$")


@dataclass(frozen=True)
class Warehouse:
    """Where the tables of a load live: two schemas under one folder."""

    spark: SparkSession
    root: str
    data_schema: str = "ref"
    backup_schema: str = "bkp"

    def prepare(self) -> Warehouse:
        for schema in (self.data_schema, self.backup_schema):
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}` LOCATION '{os.path.join(self.root, schema)}'")
        return self

    def main(self, base: str) -> str:
        return f"{self.data_schema}.{base}"

    def stage(self, base: str) -> str:
        return f"{self.data_schema}.{base}{STAGE_SUFFIX}"

    def backup(self, base: str) -> str:
        return f"{self.backup_schema}.{base}{BACKUP_SUFFIX}"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(table)

    def table(self, table: str) -> DataFrame:
        return self.spark.table(table)

    def new_location(self, table: str) -> str:
        return os.path.join(self.root, *table.split("."), uuid.uuid4().hex[:12])


def declared_schema(df: DataFrame, declared: dict[str, str] | None = None) -> T.StructType:
    """Schema of ``df`` with the declared type of each column kept as its comment."""
    fields = []
    for field in df.schema.fields:
        comment = (declared or {}).get(field.name) or LOAD_COLUMNS.get(field.name)
        fields.append(T.StructField(field.name, field.dataType, True, {"comment": comment} if comment else {}))
    return T.StructType(fields)


def write_beside(wh: Warehouse, table: str, df: DataFrame) -> str:
    """Write rows to a new folder of a table, not yet visible in it."""
    location = wh.new_location(table)
    df.write.mode("overwrite").parquet(location)
    return location


def register_table(
    wh: Warehouse, table: str, location: str, df: DataFrame, declared: dict[str, str] | None = None
) -> None:
    """Make a folder the table of this name; an older table of that name is dropped (its folder stays)."""
    wh.spark.sql(f"DROP TABLE IF EXISTS {table}")
    wh.spark.catalog.createTable(table, path=location, source="parquet", schema=declared_schema(df, declared), **{NESTED: "true"})


def create_table(wh: Warehouse, table: str, df: DataFrame, declared: dict[str, str] | None = None) -> None:
    """Write ``df`` and make a table of it."""
    register_table(wh, table, write_beside(wh, table, df), df, declared)


def ensure_table(wh: Warehouse, table: str, empty: DataFrame) -> None:
    """Make a table without rows if there is none. Of several that try at once one succeeds, and all go on with its table."""
    if wh.exists(table):
        return
    location = write_beside(wh, table, empty)
    try:
        wh.spark.catalog.createTable(table, path=location, source="parquet", schema=declared_schema(empty), **{NESTED: "true"})
    except AnalysisException as problem:
        if problem.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
            raise


def point_table(wh: Warehouse, table: str, location: str) -> None:
    """Have a table show another folder."""
    wh.spark.sql(f"ALTER TABLE {table} SET LOCATION '{location}'")
    wh.spark.catalog.refreshTable(table)


def table_details(wh: Warehouse, table: str) -> dict[str, str]:
    """What the catalog says of a table beside its columns."""
    rows = wh.spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
    start = next(i for i, r in enumerate(rows) if r.col_name.startswith("# Detailed"))
    return {r.col_name: r.data_type for r in rows[start + 1 :]}


def table_location(wh: Warehouse, table: str) -> str:
    """The folder that a table shows."""
    return table_details(wh, table)["Location"]


def replace_rows(wh: Warehouse, table: str, df: DataFrame) -> None:
    """Replace all rows of a table, keeping its columns; ``df`` may read the table itself."""
    point_table(wh, table, write_beside(wh, table, align_to(df, wh.table(table))))


def append_rows(wh: Warehouse, table: str, df: DataFrame) -> None:
    """Add rows to a table, keeping its columns.

    The rows go to a folder of their own within the table's, so that several appends at once do not share a job folder,
    and a lost one leaves nothing that counts. A table that does not look into folders is added to as usual.
    """
    rows, details = align_to(df, wh.table(table)), table_details(wh, table)
    if f"{NESTED}=true" in details.get("Storage Properties", ""):
        rows.write.parquet(os.path.join(details["Location"], uuid.uuid4().hex[:12]))
        wh.spark.catalog.refreshTable(table)
    else:
        rows.write.insertInto(table)


def align_to(df: DataFrame, target: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of ``target``: matched without case, missing ones NULL."""
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )
