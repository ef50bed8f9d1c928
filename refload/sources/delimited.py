"""Delimited text files as all-string rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refload.functions.cells import field_count, parse_fields
from refload.functions.text import sanitize_identifier
from refload.operators.names import dedupe_header
from refload.session import materialize

# Columns that say where a record stood; all start with an underscore and never reach a table.
FILE, BLOCK, POSITION, RAW = "_file", "_block", "_pos", "_raw"
POSITION_COLUMNS = [FILE, BLOCK, POSITION, RAW]


# Encodings with other names here, those in which a line break is no single byte, and those
# the reader takes only with its older rules for names.
ENCODING_NAMES = {"ascii": "utf-8", "utf-8-sig": "utf-8", "cp1252": "windows-1252"}
WIDE_ENCODINGS = ("utf-16", "utf-32")
OLDER_ENCODINGS = ("windows-1252",)


@dataclass(frozen=True)
class DelimitedFormat:
    """How the files of a batch are written."""

    column_delimiter: str = ","
    text_qualifier: str = '"'
    row_delimiter: str = "\n"
    skip_lines: int = 0
    has_header: bool = True
    has_trailer: bool = False
    encoding: str = "utf-8"
    multi_line: bool = False

    @property
    def charset(self) -> str:
        return ENCODING_NAMES.get(self.encoding.lower(), self.encoding.lower())

    @property
    def whole_files(self) -> bool:
        """Whether a file has to be read by one task: quoted line breaks, or line breaks of several bytes."""
        return self.multi_line or self.charset.startswith(WIDE_ENCODINGS)

    @property
    def line_separator(self) -> str | None:
        """The separator to force, or None to let the reader accept LF, CRLF and CR."""
        text = self.row_delimiter.replace("\\r", "\r").replace("\\n", "\n")
        if "\r\n" in text or text == "\n":
            return None
        if "\n" in text:
            return "\n"
        return "\r" if "\r" in text else None


def _reader(spark: SparkSession, fmt: DelimitedFormat):
    options = {
        "sep": fmt.column_delimiter,
        "quote": fmt.text_qualifier or "\u0000",
        "escape": fmt.text_qualifier or "\u0000",
        "encoding": fmt.charset,
        "multiLine": fmt.whole_files,
        "mode": "PERMISSIVE",
        "maxCharsPerColumn": "-1",
        "columnNameOfCorruptRecord": RAW,
    }
    reader = spark.read.options(**options)
    return reader.option("lineSep", fmt.line_separator) if fmt.line_separator else reader


@contextmanager
def charset_rules(spark: SparkSession, fmt: DelimitedFormat) -> Iterator[None]:
    """Let the reader take the encoding while scans of this format are planned and run."""
    key = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(key)
    if fmt.charset in OLDER_ENCODINGS:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_header(spark: SparkSession, path: str, fmt: DelimitedFormat) -> tuple[list[str], list[str]]:
    """Header fields of a file as written, and as column names: valid, unique, blank ones still ``''``.

    A file without a header has no fields and the names ``column_1``, ``column_2``... by the width of its first
    record. Only the lines up to the header come to the driver.
    """
    whole = {"sep": "\u0001", "quote": "\u0000", "escape": "\u0000"}
    text = _reader(spark, fmt).options(**whole).schema("value string").csv(path)
    lines = [r.value for r in text.limit(fmt.skip_lines + 1).collect()]
    if len(lines) <= fmt.skip_lines:
        raise ValueError(f"{path} has no header line")
    fields = parse_fields(F.lit(lines[-1].rstrip("\r")), F.lit(fmt.column_delimiter), F.lit(fmt.text_qualifier))
    cut = spark.range(1).select(fields.alias("raw"))
    if not fmt.has_header:
        return [], [f"column_{i}" for i in range(1, len(cut.first()["raw"]) + 1)]
    row = cut.select("raw", dedupe_header(F.transform("raw", sanitize_identifier)).alias("names")).first()
    return list(row["raw"]), list(row["names"])


def header_names(spark: SparkSession, path: str, fmt: DelimitedFormat) -> list[str]:
    """Column names of a file."""
    return read_header(spark, path, fmt)[1]


def reader_checks(fmt: DelimitedFormat, header: list[str] | None) -> bool:
    """Whether the reader can hold the first line of every file against ``header`` (unique names, none blank)."""
    folded = [h.lower() for h in header or []]
    return fmt.has_header and fmt.skip_lines == 0 and bool(folded) and all(folded) and len(set(folded)) == len(folded)


def must_compare(fmt: DelimitedFormat, header: list[str] | None) -> bool:
    """Whether headers have to be compared as records, because the reader cannot."""
    return fmt.has_header and bool(header) and not reader_checks(fmt, header)


def scan_records(
    spark: SparkSession, paths: str | list[str], names: list[str], fmt: DelimitedFormat, header: list[str] | None = None
) -> DataFrame:
    """Every record of the files with its place: file, start of its block, running position, raw text if odd.

    A column whose name is blank is read under a number and dropped. ``_raw`` is filled only where the
    number of fields differs from the number of names. With ``header``, the fields the first lines must hold,
    a file with other columns fails the scan instead of being read into the wrong ones; a header that the reader
    cannot check is left among the records.
    """
    plain_header = fmt.has_header and fmt.skip_lines == 0 and not must_compare(fmt, header)
    checked = reader_checks(fmt, header)
    read = list(header) if checked else [name or f"_unnamed{i}" for i, name in enumerate(names)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*read, RAW]])
    reader = _reader(spark, fmt).schema(schema).option("header", plain_header).option("enforceSchema", not checked)
    rows = reader.csv(paths)
    cells = [F.coalesce(F.col("`" + n.replace("`", "``") + "`"), F.lit("")) for n in read]
    return rows.select(
        *[cell.alias(given) for cell, given in zip(cells, names, strict=True) if given],
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(POSITION),
        RAW,
    )


def data_columns(df: DataFrame) -> list[str]:
    """Columns of the records themselves."""
    return [c for c in df.columns if c not in POSITION_COLUMNS]


def number_records(records: DataFrame) -> DataFrame:
    """Add ``_record`` (0 for the first of its file) and ``_records`` (how many the file has).

    Positions rise within a block, so counting records per block and summing the counts of earlier blocks
    numbers a file of any size without sorting it. ``records`` must be materialised: positions are only
    comparable between readers of the same stored table. One row per block is aggregated and joined back.
    """
    by_file = Window.partitionBy(FILE)
    before = by_file.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        records.groupBy(FILE, BLOCK)
        .agg(F.min(POSITION).alias("_first"), F.count("*").alias("_count"))
        .withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
        .withColumn("_records", F.sum("_count").over(by_file))
        .drop("_count")
    )
    joined = records.join(materialize(blocks, "blocks"), [FILE, BLOCK])
    return joined.withColumn("_record", F.col(POSITION) - F.col("_first") + F.col("_before")).drop("_first", "_before")


def skip_leading_lines(numbered: DataFrame, lines: int) -> DataFrame:
    """Drop the first ``lines`` records of each file."""
    return numbered.where(F.col("_record") >= lines)


def last_records(records: DataFrame) -> DataFrame:
    """File and position of the last record of each file: one number a block, then one a file."""
    blocks = records.groupBy(FILE, BLOCK).agg(F.max(POSITION).alias(POSITION))
    return blocks.groupBy(FILE).agg(F.max_by(POSITION, BLOCK).alias(POSITION))


def drop_trailer(records: DataFrame) -> DataFrame:
    """Drop the last record of each file. ``records`` must be materialised, like those that are numbered.

    What leaves is one row a file, so adaptive execution sends it to the tasks; the records are not numbered or moved.
    """
    return records.join(last_records(records), [FILE, POSITION], "left_anti")


def refuse_other_headers(numbered: DataFrame, fmt: DelimitedFormat, names: list[str], header: list[str]) -> None:
    """Raise if a file's header record is not ``header``; the first such files are named."""
    same = F.col(RAW).isNull()
    for name, field in zip(names, header, strict=True):
        if name:
            same = same & (F.col(f"`{name}`") == field)
    other = numbered.where((F.col("_record") == fmt.skip_lines) & ~same).select(FILE).limit(5).collect()
    if other:
        raise ValueError("files with other columns: " + ", ".join(sorted(r[FILE] for r in other)))


def scan_delimited(
    spark: SparkSession,
    paths: str | list[str],
    fmt: DelimitedFormat,
    names: list[str] | None = None,
    header: list[str] | None = None,
) -> DataFrame:
    """Read files of one table as strings, with skipped lines, header and trailer gone and places kept.

    Without lines to skip or a trailer this is one lazy scan; otherwise records are stored once, because
    first and last lines can only be told apart by position. The header of every file is compared with that of the
    first: other columns, or the same ones in another order, are an error.
    """
    if names is None:
        first = paths if isinstance(paths, str) else paths[0]
        header, names = read_header(spark, first, fmt)
    records = scan_records(spark, paths, names, fmt, header)
    compare = must_compare(fmt, header)
    if fmt.skip_lines == 0 and not fmt.has_trailer and not compare:
        return records
    stored = materialize(records, "records")
    kept = drop_trailer(stored) if fmt.has_trailer else stored
    if compare:
        refuse_other_headers(number_records(stored), fmt, names, header)
    if fmt.skip_lines or compare:
        kept = skip_leading_lines(number_records(kept), fmt.skip_lines + int(fmt.has_header)).drop("_record", "_records")
    return kept


def record_width(records: DataFrame, fmt: DelimitedFormat, expected: int) -> Column:
    """Number of fields of a record; regular records were not kept raw and have the expected number."""
    counted = field_count(F.col(RAW), F.lit(fmt.column_delimiter), F.lit(fmt.text_qualifier))
    return F.when(F.col(RAW).isNull(), F.lit(expected)).otherwise(counted)


def file_verdicts(records: DataFrame, fmt: DelimitedFormat, expected: int) -> DataFrame:
    """Per file: records, those with too many and too few fields, and whether the file may be loaded."""
    wide = records.withColumn("_width", record_width(records, fmt, expected))
    return (
        wide.groupBy(FILE)
        .agg(
            F.count("*").alias("records"),
            F.count_if(F.col("_width") > expected).alias("long_records"),
            F.count_if(F.col("_width") < expected).alias("short_records"),
        )
        .withColumn("accepted", F.col("long_records") == 0)
    )


def reject_ragged(records: DataFrame, fmt: DelimitedFormat, expected: int) -> tuple[DataFrame, DataFrame]:
    """Records of the files that hold no record with too many fields, and the verdict on every file.

    A short record is completed with empty fields, which the scan has done. The records are stored first: a
    reader asked for few columns would not see which records are odd. The verdicts are one row per file; the
    rejected ones leave the records by an anti-join.
    """
    stored = materialize(records, "records")
    verdicts = materialize(file_verdicts(stored, fmt, expected), "verdicts")
    return stored.join(verdicts.where(~F.col("accepted")).select(FILE), FILE, "left_anti"), verdicts


def write_delimited(df: DataFrame, path: str, fmt: DelimitedFormat) -> None:
    """Write all columns as text in the given format."""
    df.select([F.col(c).cast("string") for c in df.columns]).write.options(
        sep=fmt.column_delimiter,
        quote=fmt.text_qualifier,
        escape=fmt.text_qualifier,
        header=fmt.has_header,
        encoding=fmt.encoding,
        quoteAll=True,
    ).csv(path)
