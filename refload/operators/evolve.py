"""Schemas of tables: descriptions, differences, and changes that keep the data.

A column's declared type (such as ``varchar(1024)``) is its comment in the catalog; the stored type of a
text column is STRING, so widening it touches no data.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refload.functions.text import rotated_table_name
from refload.functions.times import ntz
from refload.functions.types import canonical_type, is_safe_widening, width_bucket
from refload.operators.tables import LOAD_COLUMNS, LOAD_TIME, LOAD_TYPE, VERSION, Warehouse
from refload.operators.versions import create_backup
from refload.session import local_rows

COLUMNS_SCHEMA = (
    "name string, data_type string, max_length int, numeric_precision int, numeric_scale int,"
    "nullable boolean, position int"
)
BACKUP_COLUMNS = {**LOAD_COLUMNS, VERSION: "int"}
# How stored types are called in a description.
TYPE_NAMES = {"string": "varchar", "timestamp_ntz": "datetime", "timestamp": "datetime", "long": "bigint"}


def describe_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """One row per column: type, sizes, nullability, place. Reads the schema only."""
    rows = []
    for place, field in enumerate(df.schema.fields, 1):
        kind = field.dataType
        name = TYPE_NAMES.get(kind.typeName(), kind.simpleString().split("(")[0])
        precision = kind.precision if isinstance(kind, T.DecimalType) else None
        scale = kind.scale if isinstance(kind, T.DecimalType) else None
        length = getattr(kind, "length", None)
        declared = field.metadata.get("comment", "")
        if declared.startswith("varchar("):
            size = declared[len("varchar(") : -1]
            name, length = "varchar", -1 if size.lower() == "max" else int(size)
        elif declared and isinstance(kind, T.StringType):
            name = declared
        rows.append((field.name, name, length, precision, scale, field.nullable, place))
    return local_rows(spark, rows, COLUMNS_SCHEMA)


def with_canonical_type(columns: DataFrame) -> DataFrame:
    """Add ``type`` to column descriptions."""
    sizes = [F.col(c) for c in ("max_length", "numeric_precision", "numeric_scale")]
    return columns.withColumn("type", canonical_type(F.col("data_type"), *sizes))


def schema_diff(expected: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Compare column relations (``keys``, ``name``, ``type``): added, matching, mismatched or extra.

    The join key is the table and the column name, which is unique on both sides.
    """
    left = expected.select(*keys, F.lower("name").alias("name"), F.col("type").alias("expected_type"))
    right = existing.select(*keys, F.lower("name").alias("name"), F.col("type").alias("existing_type"))
    verdict = (
        F.when(F.col("existing_type").isNull(), F.lit("added"))
        .when(F.col("expected_type").isNull(), F.lit("extra"))
        .when(F.col("existing_type") == F.col("expected_type"), F.lit("skipped"))
        .otherwise(F.lit("mismatched"))
    )
    return left.join(right, [*keys, "name"], "full_outer").withColumn("verdict", verdict)


def widening_verdicts(diff: DataFrame) -> DataFrame:
    """Add ``safe`` to a schema difference: whether an existing column may take the expected type."""
    safe = F.when(
        F.col("verdict") == "mismatched", is_safe_widening(F.col("existing_type"), F.col("expected_type"))
    ).otherwise(F.lit(True))
    return diff.withColumn("safe", safe)


def column_set_ops(expected: DataFrame, existing: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of either relation that the other lacks, marked ``missing`` or ``extra``."""
    left, right = expected.select(*columns), existing.select(*columns)
    missing = left.exceptAll(right).withColumn("side", F.lit("missing"))
    return missing.unionByName(right.exceptAll(left).withColumn("side", F.lit("extra")))


def infer_widths(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Text type of each column from its longest value: one aggregate over all columns, whole data.

    With ``keys`` the widths are found per group (for instance per file).
    """
    keys = keys or []
    longest = df.groupBy(*keys).agg(*[F.max(F.length(F.col(c))).alias(f"_w{i}") for i, c in enumerate(columns)])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"_w{i}").alias("longest")) for i, c in enumerate(columns)]
    )
    rows = longest.select(*keys, F.explode(pairs).alias("_c")).select(*keys, "_c.column_name", "_c.longest")
    return rows.withColumn("data_type", width_bucket(F.col("longest")))


def _physical(declared: str) -> str:
    base = declared.lower().split("(")[0].strip()
    return {"datetime": "TIMESTAMP_NTZ", "int": "INT", "int not null": "INT", "bigint": "BIGINT"}.get(base, "STRING")


def add_columns(wh: Warehouse, table: str, columns: dict[str, str]) -> list[str]:
    """Add the columns a table lacks (names compared without case); old rows read NULL there."""
    have = {c.lower() for c in wh.table(table).columns}
    new = {n: t for n, t in columns.items() if n.lower() not in have}
    if new:
        parts = ", ".join(f"`{n}` {_physical(t)} COMMENT '{t}'" for n, t in new.items())
        wh.spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({parts})")
        wh.spark.catalog.refreshTable(table)
    return list(new)


def ensure_metadata_columns(wh: Warehouse, table: str, backup: bool = False) -> list[str]:
    """Add the load columns a main or backup table lacks.

    The version of a backup is a partition column and there from the start.
    """
    wanted = {n: t for n, t in (BACKUP_COLUMNS if backup else LOAD_COLUMNS).items() if n != VERSION}
    return add_columns(wh, table, wanted)


def data_fields(df: DataFrame) -> DataFrame:
    """Description of the columns that are data."""
    described = describe_table(df.sparkSession, df)
    return with_canonical_type(described).where(~F.lower("name").isin(LOAD_TIME, LOAD_TYPE, VERSION))


def compare_table(wh: Warehouse, table: str, columns: dict[str, str]) -> list[tuple[str, str, str | None, str | None, bool]]:
    """Schema difference of one table as a list; its size is the number of columns."""
    none = F.lit(None).cast("int")
    pairs = local_rows(wh.spark, list(columns.items()), "name string, data_type string")
    expected = pairs.withColumn("type", canonical_type(F.col("data_type"), none, none, none))
    diff = widening_verdicts(schema_diff(expected, data_fields(wh.table(table)), []))
    return [(r["name"], r.verdict, r.existing_type, r.expected_type, r.safe) for r in diff.collect()]


def has_columns(wh: Warehouse, table: str, columns: dict[str, str]) -> bool:
    """Whether a table has all columns with just these declared types, seen from its schema alone."""
    have = {f.name.lower(): f.metadata.get("comment", "").lower() for f in wh.table(table).schema.fields}
    return all(have.get(n.lower()) == t.lower() for n, t in columns.items())


def sync_columns_add_only(wh: Warehouse, table: str, columns: dict[str, str]) -> dict[str, list[str]]:
    """Add the file's columns the table lacks; existing columns keep their types.

    Returns the names by verdict: added, skipped, mismatched, extra.
    """
    report: dict[str, list[str]] = {"added": [], "skipped": [], "mismatched": [], "extra": []}
    for name, verdict, *_ in compare_table(wh, table, columns):
        report[verdict].append(name)
    add_columns(wh, table, columns)
    return {k: sorted(v) for k, v in report.items()}


def _set_declared(wh: Warehouse, table: str, types: dict[str, str]) -> None:
    for name, declared in types.items():
        wh.spark.sql(f"ALTER TABLE {table} ALTER COLUMN `{name}` COMMENT '{declared}'")
    wh.spark.catalog.refreshTable(table)


def _rewrite_as_text(wh: Warehouse, table: str, types: dict[str, str]) -> None:
    """Store columns of other types as text: rows are rewritten beside the table, which then moves there."""
    old = wh.table(table)
    wanted = {n.lower(): t for n, t in types.items()}
    comments = {f.name: wanted.get(f.name.lower(), f.metadata.get("comment")) for f in old.schema.fields}
    rows = old.select(*[F.col(c).cast("string").alias(c) if c.lower() in wanted else F.col(c) for c in old.columns])
    location = wh.new_location(table)
    partitions = [c.name for c in wh.spark.catalog.listColumns(table) if c.isPartition]
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(location)
    parts = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" + (f" COMMENT '{comments[f.name]}'" if comments[f.name] else "")
        for f in rows.schema.fields
    )
    by = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    # The new table is whole under a name of its own before the old one goes.
    beside = f"{table}__{location.rsplit('/', 1)[1]}"
    wh.spark.sql(f"CREATE TABLE {beside} ({parts}) USING parquet {by} LOCATION '{location}'")
    if partitions:
        wh.spark.sql(f"MSCK REPAIR TABLE {beside}")
    wh.spark.sql(f"DROP TABLE {table}")
    wh.spark.sql(f"ALTER TABLE {beside} RENAME TO {table}")


def _apply_types(wh: Warehouse, table: str, types: dict[str, str]) -> None:
    """Give columns new declared types; only columns not stored as text are rewritten."""
    stored = {f.name.lower(): f.dataType for f in wh.table(table).schema.fields}
    convert = {n: t for n, t in types.items() if _physical(t) == "STRING" and not isinstance(stored[n.lower()], T.StringType)}
    if convert:
        _rewrite_as_text(wh, table, convert)
    _set_declared(wh, table, {n: t for n, t in types.items() if n not in convert})


def sync_columns_widen(wh: Warehouse, table: str, columns: dict[str, str]) -> dict[str, list[str]]:
    """Add missing columns, widen text columns and turn all others into text."""
    report: dict[str, list[str]] = {"added": [], "widened": [], "skipped": []}
    change: dict[str, str] = {}
    targets = {n.lower(): t for n, t in columns.items()}
    for name, verdict, old, new, safe in compare_table(wh, table, columns):
        if verdict == "added":
            report["added"].append(name)
        elif verdict == "mismatched" and (new or "").startswith("varchar") and (
            not (old or "").startswith("varchar") or (safe and not (old or "").endswith("(max)"))
        ):
            report["widened"].append(name)
            change[name] = targets[name]
        elif verdict != "extra":
            report["skipped"].append(name)
    add_columns(wh, table, columns)
    _apply_types(wh, table, change)
    return {k: sorted(v) for k, v in report.items()}


def sync_backup_schema(wh: Warehouse, base: str, columns: dict[str, str]) -> dict[str, object]:
    """Bring a backup table to the columns of its main table, or report why that would lose data.

    Every change is judged before the first is made, so a refused table is left as it was.
    """
    table = wh.backup(base)
    targets = {n.lower(): t for n, t in columns.items()}
    diff = compare_table(wh, table, columns)
    errors = [f"Incompatible type change for column {n}: {old} -> {new}" for n, v, old, new, safe in diff if not safe]
    added = sorted(n for n, v, *_ in diff if v == "added")
    modified = sorted(n for n, v, *_ in diff if v == "mismatched")
    if errors:
        return {"success": False, "errors": sorted(errors), "added": [], "modified": []}
    add_columns(wh, table, columns)
    _apply_types(wh, table, {n: targets[n] for n in modified})
    return {"success": True, "errors": [], "added": added, "modified": modified}


def backup_rotate(wh: Warehouse, base: str, at: datetime) -> str:
    """Set an incompatible backup table aside under a dated name and start a new, empty one."""
    table = wh.backup(base)
    old = wh.spark.range(1).select(rotated_table_name(F.lit(table.split(".")[1]), ntz(at)).alias("name")).first()["name"]
    wh.spark.sql(f"ALTER TABLE {table} RENAME TO {wh.backup_schema}.{old}")
    create_backup(wh, base, wh.table(wh.main(base)))
    return old


def ensure_backup(wh: Warehouse, base: str, columns: dict[str, str], at: datetime) -> None:
    """Have a backup table that can hold the main table: keep, evolve or rotate it."""
    if not wh.exists(wh.backup(base)):
        create_backup(wh, base, wh.table(wh.main(base)))
    elif not has_columns(wh, wh.backup(base), columns) and not sync_backup_schema(wh, base, columns)["success"]:
        backup_rotate(wh, base, at)
    ensure_metadata_columns(wh, wh.backup(base), backup=True)
