"""Listings of files and the rules for letting a file in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.functions.text import base_name

# Bytes per megabyte, the least size shown for a file that holds something, the largest
# file taken in, and the extension wanted.
MEGABYTE = 1024 * 1024
LEAST_MB = 0.01
MAX_FILE_BYTES = 20 * MEGABYTE
EXTENSION = ".csv"


def size_mb(size: Column) -> Column:
    """Size in megabytes, two places; a file that is not empty never shows as 0."""
    rounded = F.round(size / F.lit(MEGABYTE), 2)
    return F.when((size > 0) & (rounded == 0), F.lit(LEAST_MB)).otherwise(rounded)


def file_inventory(spark: SparkSession, folder: str, glob: str = "*.csv", recursive: bool = False) -> DataFrame:
    """Path, name, size and time of the files in a folder; their contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", recursive)
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    return files.select(
        F.col("path").alias("file_path"),
        base_name(F.col("path")).alias("filename"),
        F.col("length").alias("size_bytes"),
        size_mb(F.col("length")).alias("size_mb"),
        F.col("modificationTime").alias("modified_time"),
    )


def admit_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Add ``errors`` and ``valid`` to a listing with ``filename``, ``size_bytes`` and ``size_mb``."""
    limit = max_bytes / MEGABYTE
    too_large = F.concat(
        F.lit("File size ("),
        F.col("size_mb").cast("string"),
        F.lit(f" MB) exceeds maximum limit ({limit} MB)"),
    )
    errors = F.array_compact(
        F.array(
            F.when(F.col("size_bytes") > max_bytes, too_large),
            F.when(~F.lower("filename").endswith(EXTENSION), F.lit(f"File must have {EXTENSION} extension")),
        )
    )
    return files.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
