"""Snapshots of a main table: one full copy per version, kept apart as partitions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refload.functions.times import ntz
from refload.operators.load import note_load_types
from refload.operators.tables import (
    BASE_NAME,
    LOAD_TIME,
    LOAD_TYPE,
    VERSION,
    Warehouse,
    align_to,
    declared_schema,
    point_table,
    table_location,
    write_beside,
)
from refload.session import local_rows

# Fixed value: load type of a snapshot.
SNAPSHOT_TYPE = "backup"


def next_version(backup: DataFrame) -> DataFrame:
    """One row: the version the next snapshot gets."""
    return backup.agg((F.coalesce(F.max(VERSION), F.lit(0)) + 1).cast("int").alias("next_version"))


def stored_versions(wh: Warehouse, base: str) -> list[int]:
    """Versions of a backup table from its partition list, newest first; no data is read."""
    rows = wh.spark.sql(f"SHOW PARTITIONS {wh.backup(base)}").collect()
    return sorted((int(r[0].split("=")[1]) for r in rows), reverse=True)


def snapshot_rows(main: DataFrame, version: int | Column, at: datetime) -> DataFrame:
    """Rows of a snapshot: the data columns of the main table under new metadata."""
    data = [c for c in main.columns if c.lower() not in (LOAD_TIME, LOAD_TYPE, VERSION)]
    number = version if isinstance(version, Column) else F.lit(version)
    return main.select(*data).withColumns(
        {
            LOAD_TIME: ntz(at),
            LOAD_TYPE: F.lit(SNAPSHOT_TYPE),
            VERSION: number.cast("int"),
        }
    )


def create_backup(wh: Warehouse, base: str, main: DataFrame) -> None:
    """Make an empty backup table with the columns of the main table, partitioned by version."""
    rows = snapshot_rows(main, 0, datetime(1970, 1, 1))
    schema = declared_schema(rows, {f.name: f.metadata.get("comment") for f in main.schema.fields})
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}"
        + (f" COMMENT '{f.metadata['comment']}'" if "comment" in f.metadata else "")
        for f in schema.fields
    )
    location = wh.new_location(wh.backup(base))
    wh.spark.sql(
        f"CREATE TABLE {wh.backup(base)} ({columns}) USING parquet PARTITIONED BY ({VERSION}) LOCATION '{location}'"
    )


def snapshot_version(wh: Warehouse, base: str, at: datetime, version: int | None = None) -> int:
    """Copy the main table into the backup table as a new version and return its number.

    The version is written as one static partition, so repeating it replaces it. Columns the backup lacks
    are left out, columns only the backup has become NULL. One writer per table is assumed.
    """
    main = wh.table(wh.main(base))
    if not wh.exists(wh.backup(base)):
        create_backup(wh, base, main)
    if version is None:
        version = max(stored_versions(wh, base), default=0) + 1
    backup = wh.table(wh.backup(base))
    rows = align_to(snapshot_rows(main, version, at), backup).drop(VERSION)
    view = f"_refload_snapshot_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    try:
        wh.spark.sql(f"INSERT OVERWRITE {wh.backup(base)} PARTITION ({VERSION} = {version}) SELECT * FROM {view}")
    finally:
        wh.spark.catalog.dropTempView(view)
    return version


def filter_by_version(backup: DataFrame, version: int) -> DataFrame:
    """Rows of one version; on a stored backup this reads one partition."""
    return backup.where(F.col(VERSION) == version)


def list_versions(backup: DataFrame) -> DataFrame:
    """Versions, newest first."""
    return backup.select(VERSION).where(F.col(VERSION).isNotNull()).distinct().orderBy(F.desc(VERSION))


def version_summary(backup: DataFrame) -> DataFrame:
    """How many versions there are and which is the latest."""
    return backup.agg(
        F.count_distinct(VERSION).alias("version_count"), F.max(VERSION).alias("latest_version")
    )


def version_counts(backup: DataFrame) -> DataFrame:
    """Rows per version."""
    return backup.groupBy(VERSION).agg(F.count("*").alias("row_count"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


@dataclass(frozen=True)
class Rollback:
    """Outcome of a rollback."""

    status: str
    main_rows: int = 0
    stage_rows: int = 0
    error: str | None = None


def rollback_rows(backup: DataFrame, main: DataFrame, version: int) -> DataFrame:
    """Rows of the main table after going back to a version: shared columns from it, others NULL."""
    shared = {c.lower() for c in main.columns} & {c.lower() for c in backup.columns}
    if not shared - {VERSION}:
        raise ValueError("No common columns between backup and main tables")
    return align_to(filter_by_version(backup, version).drop(VERSION), main)


def rollback_to_version(wh: Warehouse, base: str, version: int) -> Rollback:
    """Put a version back into the main table, and into the stage table if there is one.

    The rows of both are written beside them, then both are swapped; if the second swap fails the first is taken
    back. A version that is not there is refused.
    """
    if not base or not BASE_NAME.match(base):
        return Rollback("invalid_base_name")
    if not wh.exists(wh.main(base)):
        return Rollback("main_missing")
    try:
        backup = wh.table(wh.backup(base))
        if version not in stored_versions(wh, base):
            return Rollback("version_missing")
        rows = filter_by_version(backup, version).count()
        names = [wh.main(base), *([wh.stage(base)] if wh.exists(wh.stage(base)) else [])]
        made = {n: write_beside(wh, n, rollback_rows(backup, wh.table(n), version)) for n in names}
        before = {n: table_location(wh, n) for n in names}
        swapped: list[str] = []
        try:
            for name in names:
                point_table(wh, name, made[name])
                swapped.append(name)
            note_load_types(wh, wh.main(base), set())
        except Exception:
            for name in swapped:
                point_table(wh, name, before[name])
            raise
        return Rollback("success", rows, rows if len(names) > 1 else 0)
    except Exception as problem:
        return Rollback("error", error=str(problem))


def backup_inventory(wh: Warehouse) -> DataFrame:
    """Backup tables with flags for their main and stage tables, their versions and the latest one.

    Names and partitions come from the catalog; tables are not read.
    """
    spark = wh.spark
    found = []
    for entry in spark.catalog.listTables(wh.backup_schema):
        if entry.name.endswith("_backup") and entry.tableType != "VIEW":
            base = entry.name.removesuffix("_backup")
            versions = stored_versions(wh, base)
            found.append((entry.name, base, len(versions), versions[0] if versions else None))
    schema = "backup_table string, base_name string, version_count int, latest_version int"
    backups = local_rows(spark, found, schema)
    tables = local_rows(spark, [(t.name,) for t in spark.catalog.listTables(wh.data_schema)], "name string")
    main = tables.select(F.col("name").alias("base_name"), F.lit(True).alias("_main"))
    stage = tables.where(F.col("name").endswith("_stage")).select(
        F.regexp_replace("name", "_stage$", "").alias("base_name"), F.lit(True).alias("_stage")
    )
    return (
        backups.join(main, "base_name", "left")
        .join(stage, "base_name", "left")
        .select(
            "backup_table",
            "base_name",
            F.coalesce("_main", F.lit(False)).alias("has_main"),
            F.coalesce("_stage", F.lit(False)).alias("has_stage"),
            "version_count",
            "latest_version",
        )
    )

