"""Pages of a stored version, by an index that is made once a version and kept.

The version is stored once more in the order of its pages, range by range, with the place of every row. How many rows
lie before each range is noted in a small table. A page is then a filter on places, near or far: the reader skips all
row groups but those it touches, and nothing is sorted or written for a page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.operators.tables import BASE_NAME, VERSION, Warehouse, append_rows, create_table
from refload.operators.versions import filter_by_version, stored_versions
from refload.session import local_rows

# Page size if none is asked for, and the largest.
PAGE_DEFAULT, PAGE_MAX = 50, 1000
PLACE = "_place"
#: Rows of a range lie at consecutive places from ``range * 2^33`` on.
RANGE_BITS = 33
INDEX = "page_index"
INDEX_SCHEMA = "source_table string, version int, stored string, location string, range long, before long, rows long"


@dataclass(frozen=True)
class VersionPage:
    """A page, and what a reader needs to ask for the next."""

    columns: list[str]
    total: int
    limit: int
    offset: int
    rows: DataFrame | None = None
    error: str | None = None

    @property
    def next_offset(self) -> int | None:
        """Offset of the page that follows, None after the last."""
        return self.offset + self.limit if self.offset + self.limit < self.total else None


def clamp_page(limit: object = PAGE_DEFAULT, offset: object = 0) -> tuple[int, int]:
    """Page size within 1..1000 and an offset that is not negative; nonsense becomes the default. The page tells both."""

    def number(value: object, default: int) -> int:
        try:
            return int(value)  # type: ignore[call-overload]
        except (TypeError, ValueError):
            return default

    return min(max(number(limit, PAGE_DEFAULT), 1), PAGE_MAX), max(number(offset, 0), 0)


def write_ordered(rows: DataFrame, location: str) -> None:
    """Rows in the order of their first column, all others breaking ties, with their places.

    Ranges are cut by sampled quantiles over all columns, so one value of the first column may span many ranges.
    """
    order = [F.col(f"`{c}`").asc_nulls_first() for c in rows.columns]
    wide = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = rows.repartitionByRange(wide, *order).sortWithinPartitions(*order)
    ranged.withColumn(PLACE, F.monotonically_increasing_id()).write.mode("overwrite").parquet(location)


def range_counts(spark: SparkSession, location: str) -> list[tuple[int, int, int]]:
    """(range, rows before it, rows in it) of a stored order, read from one column; a row a range."""
    counted = spark.read.parquet(location).groupBy(F.shiftright(PLACE, RANGE_BITS).alias("r")).agg(F.count("*").alias("n"))
    found, before = [], 0
    for row in sorted(counted.collect(), key=lambda x: x.r):
        found.append((row.r, before, row.n))
        before += row.n
    return found


def _stored(wh: Warehouse, base: str, version: int) -> str:
    """A name for what is stored of a version; storing it again gives another."""
    names = filter_by_version(wh.table(wh.backup(base)), version).select(F.col("_metadata.file_path").alias("f")).distinct()
    told = names.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("f")), F.lit(0)).alias("x")).first()
    return f"{told.n}-{told.x}"


def build_page_index(wh: Warehouse, base: str, version: int) -> DataFrame:
    """The index rows of a version, made and noted if they are not there or the version was stored anew since."""
    name, stored = wh.main(INDEX), _stored(wh, base, version)
    if not wh.exists(name):
        create_table(wh, name, local_rows(wh.spark, [], INDEX_SCHEMA))
    noted = wh.table(name).where((F.col("source_table") == base) & (F.col("version") == version) & (F.col("stored") == stored))
    if noted.isEmpty():
        location = wh.new_location(f"{wh.backup(base)}_pages")
        write_ordered(filter_by_version(wh.table(wh.backup(base)), version).drop(VERSION), location)
        made = [(base, version, stored, location, *r) for r in range_counts(wh.spark, location)]
        made = made or [(base, version, stored, location, 0, 0, 0)]
        append_rows(wh, name, local_rows(wh.spark, made, INDEX_SCHEMA))
        noted = wh.table(name).where((F.col("source_table") == base) & (F.col("version") == version) & (F.col("stored") == stored))
    first = noted.agg(F.min("location")).first()[0]  # two makers at once both note theirs
    return noted.where(F.col("location") == first)


def read_places(rows: DataFrame, index: list[tuple[int, int, int]], limit: int, offset: int) -> DataFrame:
    """The rows from ``offset`` on, as a filter on places; ``rows`` are a stored order, ``index`` its ranges."""
    wanted = F.lit(False)
    for number, before, n in index:
        low, high = max(offset - before, 0), min(offset + limit - before, n)
        if low < high:
            start = number << RANGE_BITS
            wanted = wanted | F.col(PLACE).between(start + low, start + high - 1)
    return rows.where(wanted).orderBy(PLACE).drop(PLACE)


def page_version_rows(wh: Warehouse, base: str, version: int, limit: object = PAGE_DEFAULT, offset: object = 0) -> VersionPage:
    """A page of a version of a table: its columns, the total of rows, limit and offset as they were taken, and the rows.

    A base name that is none, or a version that is not there, gives an empty page with the reason. The version's index is
    made by the first page asked for, unless ``build_page_index`` was called before.
    """
    size, start = clamp_page(limit, offset)
    if not base or not BASE_NAME.match(base):
        return VersionPage([], 0, size, start, error="invalid_base_name")
    if not wh.exists(wh.backup(base)):
        return VersionPage([], 0, size, start, error="backup_missing")
    backup = wh.table(wh.backup(base))
    if version not in stored_versions(wh, base):
        return VersionPage(backup.columns, 0, size, start, error="version_missing")
    index = build_page_index(wh, base, version).collect()
    ranges = sorted((r["range"], r["before"], r["rows"]) for r in index)
    rows = wh.spark.read.parquet(index[0]["location"])
    page = read_places(rows, ranges, size, start).withColumn(VERSION, F.lit(version).cast("int")).select(backup.columns)
    return VersionPage(backup.columns, sum(r[2] for r in ranges), size, start, page)
