"""Staging, aligning and promoting the rows of a batch."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refload.functions.text import clean_null_tokens, sanitize_identifier
from refload.functions.times import ntz
from refload.operators.tables import (
    LOAD_TIME,
    LOAD_TYPE,
    Warehouse,
    align_to,
    append_rows,
    create_table,
    replace_rows,
)

# Codes and spellings of the two load types.
FULL, APPEND = "F", "A"
FULL_WORDS = ["F", "FULL", "FULLLOAD"]
APPEND_WORDS = ["A", "APPEND"]
MODES = {FULL: "fullload", APPEND: "append"}
DEFAULT_MODE = "fullload"
#: Property of a table that tells the load types of its rows.
NOTED_TYPES = "refload.load_types"


def load_code(word: str | None) -> str | None:
    """``F`` or ``A`` for any spelling of a load type, else None."""
    text = (word or "").strip().upper()
    return FULL if text in FULL_WORDS else APPEND if text in APPEND_WORDS else None


def project_valid_columns(df: DataFrame) -> DataFrame:
    """Rename columns to valid names and drop those whose name is blank.

    Only the names are looked at, so this costs no pass over the rows.
    """
    names = F.array(*[sanitize_identifier(F.lit(c)) for c in df.columns])
    valid = df.sparkSession.range(1).select(names.alias("names")).first()["names"]
    return df.select(*[df[f"`{old}`"].alias(new) for old, new in zip(df.columns, valid, strict=True) if new])


def clean_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Strip every cell and turn the texts that mean "no value" into NULL."""
    wanted = columns or df.columns
    return df.select(*[clean_null_tokens(F.col(c)).alias(c) if c in wanted else F.col(c) for c in df.columns])


def stamp_load_metadata(df: DataFrame, load_time: datetime, code: str) -> DataFrame:
    """Add one load time and one load type for the whole batch."""
    return df.withColumns({LOAD_TIME: ntz(load_time), LOAD_TYPE: F.lit(code)})


@dataclass
class Alignment:
    """Which stage columns go to the main table."""

    shared: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    defaulted: list[str] = field(default_factory=list)


def align_columns(stage: DataFrame, main: DataFrame) -> Alignment:
    """Columns of both, only of the stage, only of the main table; names are compared without case."""
    stage_names, main_names = {c.lower() for c in stage.columns}, {c.lower() for c in main.columns}
    found = Alignment(
        shared=[c for c in stage.columns if c.lower() in main_names],
        skipped=[c for c in stage.columns if c.lower() not in main_names],
        defaulted=[c for c in main.columns if c.lower() not in stage_names],
    )
    if not found.shared:
        raise ValueError("No compatible columns found between stage and main tables")
    return found


def stage_load(
    wh: Warehouse, base: str, rows: DataFrame, load_time: datetime, code: str, declared: dict[str, str] | None = None
) -> DataFrame:
    """Make the stage table anew from cleaned, stamped rows and return it."""
    create_table(wh, wh.stage(base), stamp_load_metadata(clean_rows(rows), load_time, code), declared)
    return wh.table(wh.stage(base))


def append_load(main: DataFrame, stage: DataFrame) -> DataFrame:
    """Rows of the main table after an append: old rows kept, columns of the main table."""
    align_columns(stage, main)
    return main.unionByName(align_to(stage, main))


def full_load(main: DataFrame, stage: DataFrame) -> DataFrame:
    """Rows of the main table after a full load: its columns, the rows of the stage."""
    align_columns(stage, main)
    return align_to(stage, main)


def already_loaded(main: DataFrame, load_time: datetime, earlier: int = 0) -> bool:
    """Whether the table has more rows of this load time than ``earlier`` batches of it; the filter reaches the scan."""
    return main.where(F.col(LOAD_TIME) == ntz(load_time)).limit(earlier + 1).count() > earlier


def promote(wh: Warehouse, base: str, code: str, load_time: datetime, again: bool = True, earlier: int = 0) -> None:
    """Move the stage rows into the main table by load type.

    A batch that may have come this far before (``again``) is appended only if the table has none of its rows:
    of its load time it then holds just the ``earlier`` ones, of batches that are done.
    """
    stage, name = wh.table(wh.stage(base)), wh.main(base)
    if not wh.exists(name):
        create_table(wh, name, stage, declared_types(stage))
        note_load_types(wh, name, {code})
    elif code == FULL:
        align_columns(stage, wh.table(name))
        replace_rows(wh, name, stage)
        note_load_types(wh, name, {code})
    elif not (again and already_loaded(wh.table(name), load_time, earlier)):
        align_columns(stage, wh.table(name))
        known = noted_load_types(wh, name)
        if known is not None:
            note_load_types(wh, name, known | {code})
        append_rows(wh, name, stage)


def declared_types(df: DataFrame) -> dict[str, str]:
    """Declared column types, which tables keep as comments."""
    return {f.name: f.metadata["comment"] for f in df.schema.fields if "comment" in f.metadata}


def load_type_by_key(rows: DataFrame, keys: list[str], load_type: str, mode: str) -> DataFrame:
    """Load type of each table in a relation of stored load types.

    Two flags per group are enough, so partial aggregation leaves one row per key and task to shuffle.
    """
    kind = F.upper(F.trim(F.col(load_type)))
    default = FULL if load_code(mode) == FULL else APPEND
    flags = rows.groupBy(*keys).agg(
        F.coalesce(F.bool_or(kind == FULL), F.lit(False)).alias("_full"),
        F.coalesce(F.bool_or(kind == APPEND), F.lit(False)).alias("_append"),
    )
    code = F.when(F.col("_full"), F.lit(FULL)).when(F.col("_append"), F.lit(APPEND)).otherwise(F.lit(default))
    return flags.select(*keys, code.alias("load_type"))


def determine_load_type(main: DataFrame | None, mode: str, override: str | None = None) -> str:
    """Load type of the next batch: the override, else what the table holds, else the current mode."""
    forced = load_code(override)
    if forced:
        return forced
    default = load_code(mode) or APPEND
    if main is None or LOAD_TYPE not in main.columns:
        return default
    kind = F.upper(F.trim(F.col(LOAD_TYPE)))
    seen = main.agg(F.bool_or(kind == FULL).alias("f"), F.bool_or(kind == APPEND).alias("a")).first()
    return FULL if seen["f"] else APPEND if seen["a"] else default


def noted_load_types(wh: Warehouse, table: str) -> set[str] | None:
    """The load types of a table's rows as its loads noted them, None if they did not."""
    rows = wh.spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == NOTED_TYPES).collect()
    return {t for t in rows[0]["value"].split(",") if t in (FULL, APPEND)} if rows else None


def note_load_types(wh: Warehouse, table: str, codes: set[str]) -> None:
    """Keep with a table which load types its rows have. A row's type is F, A, or that of a version put back."""
    wh.spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{NOTED_TYPES}' = '{','.join(sorted(codes)) or '-'}')")


def next_load_type(wh: Warehouse, base: str, mode: str, override: str | None = None) -> str:
    """``determine_load_type`` of a stored table without reading its rows, but for the first time at a table made otherwise."""
    forced, name = load_code(override), wh.main(base)
    if forced or not wh.exists(name):
        return forced or load_code(mode) or APPEND
    known = noted_load_types(wh, name)
    if known is None:
        found = wh.table(name)
        known = {c for c in (FULL, APPEND) if LOAD_TYPE in found.columns and holds_type(found, c)}
        note_load_types(wh, name, known)
    return FULL if FULL in known else APPEND if APPEND in known else load_code(mode) or APPEND


def holds_type(rows: DataFrame, code: str) -> bool:
    return not rows.where(F.upper(F.trim(F.col(LOAD_TYPE))) == code).limit(1).isEmpty()


def dominant_load_type(rows: DataFrame, load_type: str, load_time: Column | str, keys: list[str]) -> DataFrame:
    """Mode to offer for the next load of each table: that of its latest stored load type, if known."""
    word = F.lower(F.trim(F.col(load_type)))
    mode = (
        F.when(word.isin("f", "fullload"), F.lit(MODES[FULL]))
        .when(word.isin("a", "append"), F.lit(MODES[APPEND]))
        .otherwise(F.lit(DEFAULT_MODE))
    )
    stored = F.when(F.col(load_type).isNotNull(), F.struct(load_time, mode.alias("mode")))
    latest = rows.groupBy(*keys).agg(F.max(stored).alias("_latest"))
    return latest.select(*keys, F.coalesce(F.col("_latest.mode"), F.lit(DEFAULT_MODE)).alias("default_mode"))


def quarantine_write(wh: Warehouse, errors: DataFrame, table: str = "load_errors") -> None:
    """Append failed files with time and error to the error table."""
    name = wh.main(table)
    if wh.exists(name):
        append_rows(wh, name, errors)
    else:
        create_table(wh, name, errors)

