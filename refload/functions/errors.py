"""What an error text is about, and what to do about it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values --------------------------------------------------------------------------------------
# Marks of a database error, as spelled; words of file and validation errors, in any case.
DATABASE_MARKS = ["Msg ", "Error "]
FILE_WORDS = ["file", "csv", "encoding", "delimiter"]
VALIDATION_WORDS = ["constraint", "validation", "duplicate", "foreign key"]
# Words of an error and the advice that goes with them.
ADVICE = [
    (
        ["connection", "database"],
        [
            "Check database connection settings in config.yaml",
            "Verify database server is running and accessible",
            "Confirm database credentials are correct",
        ],
    ),
    (
        ["permission", "access"],
        [
            "Verify database user has necessary permissions",
            "Check schema access rights",
            "Confirm table creation/modification permissions",
        ],
    ),
    (
        ["column", "field"],
        [
            "Review CSV file structure and column names",
            "Check for extra or missing columns in CSV",
            "Verify data types match expected schema",
        ],
    ),
    (
        ["duplicate", "constraint"],
        [
            "Check for duplicate keys in the data",
            "Review referential integrity constraints",
            "Consider using 'append' mode instead of 'fullload'",
        ],
    ),
    (
        ["encoding", "character"],
        [
            "Try different file encoding (UTF-8, UTF-16, etc.)",
            "Check for special characters in the data",
            "Review delimiter and text qualifier settings",
        ],
    ),
]
DEFAULT_ADVICE = [
    "Review the error message for specific details",
    "Check the CSV file format and structure",
    "Verify database connection and permissions",
    "Review configuration settings in the Excel form",
    "Contact system administrator if the issue persists",
]
# ---------------------------------------------------------------------------------------------------


def _any_of(text: Column, words: list[str]) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def classify_error(message: Column) -> Column:
    """Tags of an error text: any of ``database``, ``file``, ``validation``."""
    low = F.lower(message)
    return F.array_compact(
        F.array(
            F.when(_any_of(message, DATABASE_MARKS), F.lit("database")),
            F.when(_any_of(low, FILE_WORDS), F.lit("file")),
            F.when(_any_of(low, VALIDATION_WORDS), F.lit("validation")),
        )
    )


def _texts(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def suggest_fix(message: Column) -> Column:
    """Advice for an error text: that of every word family it touches, else the general advice."""
    low = F.lower(message)
    none = F.array().cast("array<string>")
    found = F.concat(*[F.when(_any_of(low, words), _texts(steps)).otherwise(none) for words, steps in ADVICE])
    return F.when(F.size(found) > 0, found).otherwise(_texts(DEFAULT_ADVICE))
