"""A batch of delimited files into a main table, start to end.

Text is parsed once: the stage is written from the scan, and the same pass counts rows, finds records with
too many fields and measures every column. All later steps read the stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from refload.functions.times import ntz
from refload.functions.types import width_bucket
from refload.operators.evolve import data_fields, ensure_backup, ensure_metadata_columns, has_columns, sync_columns_add_only
from refload.operators.load import (
    clean_rows,
    declared_types,
    next_load_type,
    promote,
    quarantine_write,
    stamp_load_metadata,
)
from refload.operators.turns import Turn, turn
from refload.operators.registry import REGISTRY_COLUMNS, registry_row, upsert_registry
from refload.operators.tables import (
    LOAD_TIME,
    LOAD_TYPE,
    Warehouse,
    append_rows,
    ensure_table,
    register_table,
    replace_rows,
    write_beside,
)
from refload.operators.validate import Rule, validate_stage, validation_json
from refload.operators.versions import snapshot_version, stored_versions
from refload.sources.delimited import (
    FILE,
    POSITION_COLUMNS,
    DelimitedFormat,
    charset_rules,
    data_columns,
    read_header,
    record_width,
    scan_delimited,
)
from refload.session import local_rows, materialize

HISTORY = "load_history"
REGISTRY = "load_registry"
LOG = "load_log"
LOG_SCHEMA = "source_table string, load_time timestamp_ntz, phase string, at timestamp_ntz, rows long, message string"
HISTORY_SCHEMA = "source_table string, load_time timestamp_ntz, load_type string, row_count long, version int, batch string"


@dataclass(frozen=True)
class LoadResult:
    """What became of a batch."""

    base: str
    status: str
    load_type: str | None = None
    rows: int = 0
    version: int | None = None
    rejected_files: int = 0
    validation: str | None = None
    types: dict[str, str] | None = None


def log_table(wh: Warehouse, name: str, schema: str, base: str) -> DataFrame:
    """Rows about one table in one of the small tables that loads write to."""
    ensure_table(wh, wh.main(name), local_rows(wh.spark, [], schema))
    return wh.table(wh.main(name)).where(F.col("source_table") == base)


def past_loads(wh: Warehouse, base: str) -> DataFrame:
    """Finished loads of a table."""
    return log_table(wh, HISTORY, HISTORY_SCHEMA, base)


def batch_key(wh: Warehouse, paths: str | list[str]) -> str:
    """Name of a batch by its files: how many, and a hash over their paths, sizes and times. Contents are not read."""
    files = wh.spark.read.format("binaryFile").load(paths).select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    found = files.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x")).first()
    return f"{found.n}-{found.x & (2**64 - 1):016x}"


def last_version(wh: Warehouse, base: str) -> int:
    """The highest version that a load has noted or that is stored, by whatever way."""
    noted = past_loads(wh, base).agg(F.max("version")).first()[0] or 0
    stored = stored_versions(wh, base) if wh.exists(wh.backup(base)) else []
    return max([noted, *stored])


LONG = "_record_too_long"


def write_stage(
    wh: Warehouse, base: str, records: DataFrame, fmt: DelimitedFormat, load_time: datetime, code: str
) -> tuple[str, DataFrame, int, int, dict[str, int]]:
    """Write the rows of the stage: folder, shape, rows, records with too many fields, and the width of each column.

    The folder also tells each row's file, and whether its record was too long; the stage table does not show these.
    """
    columns = data_columns(records)
    seen = Observation()
    cleaned = stamp_load_metadata(clean_rows(records, columns), load_time, code)
    cleaned = cleaned.withColumn(LONG, record_width(records, fmt, len(columns)) > len(columns))
    watched = cleaned.observe(
        seen, F.count("*").alias("rows"), F.count_if(LONG).alias("long"), *[F.max(F.length(c)).alias(f"w{i}") for i, c in enumerate(columns)]
    ).drop(*[c for c in POSITION_COLUMNS if c != FILE])
    location = write_beside(wh, wh.stage(base), watched)
    found = seen.get
    return location, watched.drop(FILE, LONG), found["rows"], found["long"], {c: found[f"w{i}"] for i, c in enumerate(columns)}


def without_ragged(wh: Warehouse, base: str, location: str, shape: DataFrame, load_time: datetime) -> tuple[str, int, int, dict[str, int]]:
    """Write the stage anew without the files that hold a record too long; these are noted in the error table.

    Reads what was stored, not the text. Returns the folder, rows, rejected files, and the width of each column.
    """
    stored = wh.spark.read.parquet(location)
    bad = stored.where(LONG).groupBy(FILE).agg(F.count("*").alias("n"))
    message = F.format_string("%d records have more fields than the header", F.col("n"))
    failed = materialize(bad.select(F.col(FILE).alias("file_path"), message.alias("error"), ntz(load_time).alias("failed_at")), "ragged")
    quarantine_write(wh, failed)
    columns = [c for c in shape.columns if c not in (LOAD_TIME, LOAD_TYPE)]
    seen = Observation()
    kept = stored.join(failed.select(F.col("file_path").alias(FILE)), FILE, "left_anti").select(shape.columns)
    kept = kept.observe(seen, F.count("*").alias("rows"), *[F.max(F.length(c)).alias(f"w{i}") for i, c in enumerate(columns)])
    again = write_beside(wh, wh.stage(base), kept)
    found = seen.get
    return again, found["rows"], failed.count(), {c: found[f"w{i}"] for i, c in enumerate(columns)}


@dataclass(frozen=True)
class Staged:
    """Rows of a batch in a folder that no table shows yet."""

    location: str
    shape: DataFrame
    rows: int
    rejected: int
    types: dict[str, str]


def stage_files(wh: Warehouse, paths: str | list[str], base: str, fmt: DelimitedFormat, load_time: datetime, code: str) -> Staged:
    """Write the files of a batch, without those that hold a record with too many fields, to a folder of the stage's.

    The text is parsed once, whatever the files hold. Several batches of a table may do this at once.
    """
    header, names = read_header(wh.spark, paths if isinstance(paths, str) else paths[0], fmt)
    records = scan_delimited(wh.spark, paths, fmt, names, header)
    location, shape, rows, long, widths = write_stage(wh, base, records, fmt, load_time, code)
    rejected = 0
    if long:
        location, rows, rejected, widths = without_ragged(wh, base, location, shape, load_time)
    measured = local_rows(wh.spark, list(widths.items()), "c string, w int")
    types = {r.c: r.t for r in measured.select("c", width_bucket(F.col("w")).alias("t")).collect()}
    return Staged(location, shape, rows, rejected, types)


class PhaseLog:
    """When each phase of a load began and ended, with its rows; what ``load_throughput`` measures by ``phase``."""

    def __init__(self, base: str, load_time: datetime) -> None:
        self.key, self.rows = (base, load_time.isoformat(sep=" ")), []

    def note(self, phase: str, rows: int = 0, message: str | None = None) -> None:
        self.rows.append((*self.key, phase, datetime.now().isoformat(sep=" "), rows, message))

    def write(self, wh: Warehouse) -> None:
        log_table(wh, LOG, LOG_SCHEMA, self.key[0])
        append_rows(wh, wh.main(LOG), local_rows(wh.spark, self.rows, LOG_SCHEMA.replace("timestamp_ntz", "string")))


def load_files(
    wh: Warehouse,
    paths: str | list[str],
    base: str,
    fmt: DelimitedFormat,
    mode: str,
    load_time: datetime,
    rules: list[Rule] | Callable[[DataFrame], list[Rule]] = (),  # type: ignore[assignment]
    override: str | None = None,
) -> LoadResult:
    """Load files of one table: stage, check, promote, snapshot, register.

    Files and ``load_time`` name the batch: loading it again changes nothing, other files of the same time are
    another batch. Files with a record of too many fields are set aside and the others loaded. A broken rule stops
    before the main table is touched. Every attempt is written to the load log, whatever becomes of it.
    """
    log = PhaseLog(base, load_time)
    log.note("load")
    try:
        result = _load_files(wh, paths, base, fmt, mode, load_time, rules, override, log)
        log.note("load", result.rows, result.validation or result.status)
        return result
    except Exception as problem:
        log.note("load", 0, str(problem)[:2000])
        raise
    finally:
        log.write(wh)


def _load_files(
    wh: Warehouse,
    paths: str | list[str],
    base: str,
    fmt: DelimitedFormat,
    mode: str,
    load_time: datetime,
    rules: list[Rule] | Callable[[DataFrame], list[Rule]],
    override: str | None,
    log: PhaseLog,
) -> LoadResult:
    batch = batch_key(wh, paths)
    timed = past_loads(wh, base).where(F.col("load_time") == ntz(load_time))

    def loaded() -> LoadResult | None:
        done = wh.table(wh.main(HISTORY)).where((F.col("source_table") == base) & (F.col("load_time") == ntz(load_time)) & (F.col("batch") == batch))
        row = done.first()
        return LoadResult(base, "already_loaded", row.load_type, row.row_count, row.version) if row else None

    if done := loaded():
        return done
    code = next_load_type(wh, base, mode, override)
    log.note("stage")
    with charset_rules(wh.spark, fmt):
        staged = stage_files(wh, paths, base, fmt, load_time, code)
    log.note("stage", staged.rows)
    if staged.rows == 0:
        return LoadResult(base, "empty", code, 0, rejected_files=staged.rejected)
    # From here on one load of a table at a time, in the order of the versions they will be.
    with turn(wh, base, f"{batch}@{load_time.isoformat()}", lambda: last_version(wh, base)) as mine:
        if done := loaded():
            return done
        return _publish(wh, base, batch, staged, code, load_time, rules, log, mine, timed)


def _publish(
    wh: Warehouse, base: str, batch: str, staged: Staged, code: str, load_time: datetime,
    rules: list[Rule] | Callable[[DataFrame], list[Rule]], log: PhaseLog, mine: Turn, timed: DataFrame,
) -> LoadResult:
    """Show the stage, check it, move it to the main table, store the version and note the load."""
    rows, types = staged.rows, staged.types
    register_table(wh, wh.stage(base), staged.location, staged.shape, types)
    stage = wh.table(wh.stage(base))
    checks = rules(stage) if callable(rules) else list(rules)
    validation = None
    if checks:
        log.note("validate")
        issues = validate_stage(stage, checks)
        validation = validation_json(issues).first()["validation"]
        log.note("validate", rows, validation)
        if not validation.startswith('{"validation_result":0'):
            return LoadResult(base, "validation_failed", code, rows, None, staged.rejected, validation)

    if wh.exists(wh.main(base)):
        ensure_metadata_columns(wh, wh.main(base))
        if not has_columns(wh, wh.main(base), types):
            sync_columns_add_only(wh, wh.main(base), types)
    log.note("promote")
    earlier = timed.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("n")).first()["n"] if mine.again else 0
    promote(wh, base, code, load_time, mine.again, earlier)
    log.note("promote", rows)
    log.note("snapshot")
    ensure_backup(wh, base, main_types(wh, base), load_time)
    snapshot_version(wh, base, load_time, mine.number)
    log.note("snapshot", rows)
    register(wh, base)
    done_now = [(base, load_time.isoformat(sep=" "), code, rows, mine.number, batch)]
    append_rows(wh, wh.main(HISTORY), local_rows(wh.spark, done_now, HISTORY_SCHEMA.replace("timestamp_ntz", "string")))
    return LoadResult(base, "success", code, rows, mine.number, staged.rejected, validation, types)


def main_types(wh: Warehouse, base: str) -> dict[str, str]:
    """Declared types of the data columns of a main table."""
    main = wh.table(wh.main(base))
    known = declared_types(main)
    if all(c in known for c in main.columns):
        return {c: t for c, t in known.items() if c not in (LOAD_TIME, LOAD_TYPE)}
    described = data_fields(main)
    return {r["name"]: r["type"] for r in described.collect()}


def register(wh: Warehouse, base: str) -> None:
    """Have the registry name this table with its real schema; an entry that says so already stays."""
    spark, name = wh.spark, wh.main(REGISTRY)
    incoming = spark.range(1).select(*registry_row(F.lit(wh.root), F.lit(wh.data_schema), F.lit(base)))
    ensure_table(wh, name, incoming.limit(0))

    def merged() -> DataFrame:
        return upsert_registry(wh.table(name), incoming, "ref_name", REGISTRY_COLUMNS)

    def news() -> bool:
        return not merged().where(F.col("action").isin("insert", "update")).isEmpty()

    if news():
        with turn(wh, REGISTRY, base):  # loads of other tables write here too
            if news():
                replace_rows(wh, name, merged().drop("action"))
