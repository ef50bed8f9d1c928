"""Format descriptors: one JSON document per file that says how to read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.functions.text import base_name, file_key, is_blank

# The layout of a descriptor and its constants.
DESCRIPTOR_SCHEMA = (
    "file_info struct<original_filename:string,upload_timestamp:string,format_version:string>,"
    "csv_format struct<header_delimiter:string,column_delimiter:string,row_delimiter:string,"
    "text_qualifier:string,skip_lines:int,has_header:boolean,has_trailer:boolean,trailer_line:string>,"
    "processing_options struct<encoding:string,skip_blank_lines:boolean,strip_whitespace:boolean>,"
    "inferred_schema map<string,string>"
)
FORMAT_VERSION = "1.0"


def write_format_descriptor(
    filename: Column,
    uploaded: Column,
    header_delimiter: Column,
    column_delimiter: Column,
    row_delimiter: Column,
    text_qualifier: Column,
    skip_lines: Column,
    trailer_line: Column,
    encoding: Column,
) -> Column:
    """Descriptor as JSON text; a trailer is expected where its line is not blank."""
    document = F.struct(
        F.struct(
            filename.alias("original_filename"),
            uploaded.alias("upload_timestamp"),
            F.lit(FORMAT_VERSION).alias("format_version"),
        ).alias("file_info"),
        F.struct(
            header_delimiter.alias("header_delimiter"),
            column_delimiter.alias("column_delimiter"),
            row_delimiter.alias("row_delimiter"),
            text_qualifier.alias("text_qualifier"),
            skip_lines.alias("skip_lines"),
            F.lit(True).alias("has_header"),
            (~is_blank(trailer_line)).alias("has_trailer"),
            trailer_line.alias("trailer_line"),
        ).alias("csv_format"),
        F.struct(
            encoding.alias("encoding"),
            F.lit(True).alias("skip_blank_lines"),
            F.lit(True).alias("strip_whitespace"),
        ).alias("processing_options"),
    )
    return F.to_json(document, {"ignoreNullFields": "false"})


def read_format_descriptor(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row per descriptor, with the path of its file.

    A file is one document with any line breaks, or, where many were written together, one document a line.
    """
    return (
        spark.read.schema(DESCRIPTOR_SCHEMA)
        .option("multiLine", one_per_file)
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("descriptor_path"))
    )


def parse_descriptor(document: Column) -> Column:
    """Descriptor text as a struct."""
    return F.from_json(document, DESCRIPTOR_SCHEMA)


def persist_inferred_schema(descriptors: DataFrame, widths: DataFrame, key: str, document: str) -> DataFrame:
    """Put the column types of each file into its descriptor; ``widths`` has ``key, column_name, data_type``.

    The map of a file holds one entry per column of that file, so the group collected is as wide as a table.
    """
    types = widths.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("column_name", "data_type")))).alias("_types")
    )
    parsed = descriptors.join(types, key, "left").withColumn("_doc", parse_descriptor(F.col(document)))
    merged = F.col("_doc").withField("inferred_schema", F.coalesce("_types", "_doc.inferred_schema"))
    return parsed.withColumn(document, F.to_json(merged, {"ignoreNullFields": "false"})).drop("_types", "_doc")


DESCRIPTORS = "format_descriptors"
DESCRIPTOR_ROWS = "path string, at string, document string"


def describe_profiles(profiles: DataFrame, at: Column) -> DataFrame:
    """(path, at, document): the descriptors of profiled files."""
    document = write_format_descriptor(
        base_name(F.col("path")), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss"), F.col("header_delimiter"), F.col("column_delimiter"),
        F.col("row_delimiter"), F.col("text_qualifier"), F.col("skip_lines"), F.col("trailer_line"), F.col("encoding"),
    )
    return profiles.select(file_key(F.col("path")).alias("path"), at.alias("at"), document.alias("document"))


def newest_descriptors(stored: DataFrame) -> DataFrame:
    """The last descriptor of each file."""
    return stored.groupBy("path").agg(F.max_by("document", "at").alias("document"))
