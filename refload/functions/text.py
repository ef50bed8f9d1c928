"""Cleaning of cells and of names: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values --------------------------------------------------------------------------------------
# White space as stripped from cells and headers.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
    "    　"
)
# Cell texts that stand for a missing value, in any case.
NULL_TOKENS = ["", "none", "nan", "null"]
# Longest column name.
NAME_LIMIT = 120
# Timestamp endings of file names, removed in this order.
FILE_TIMESTAMPS = [
    r"\.\d{8}\.\d{6}$",
    r"_\d{8}_\d{6}$",
    r"\.\d{14}$",
    r"_\d{14}$",
    r"\.\d{8}$",
    r"_\d{8}$",
]
# Date parts removed from a file name when no better table name is known.
FALLBACK_DATES = [r"[-_.]\d{8}", r"[-_.]\d{4}-\d{2}-\d{2}"]
# Characters that may not stand in a stored file name.
UNSAFE_FILE_CHARS = '<>:"/\\|?*'
UNKNOWN_TABLE = "unknown_table"
# ---------------------------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (plain ``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    """Nothing but white space; stops at the first other character."""
    return c.isNull() | (F.ltrim(c, F.lit(WHITE_SPACE)) == "")


def clean_null_tokens(c: Column) -> Column:
    """Stripped text, or NULL where the cell only says that it has no value."""
    text = strip(c)
    return F.when(~F.lower(text).isin(NULL_TOKENS), text)


def sanitize_identifier(c: Column) -> Column:
    """Turn header text into a column name; blank headers become ``''``."""
    plain = F.regexp_replace(strip(c), "[^a-zA-Z0-9_]", "_")
    rooted = F.when(plain.rlike("^[A-Za-z_]"), plain).otherwise(F.concat(F.lit("col_"), plain))
    return F.when(is_blank(c), F.lit("")).otherwise(F.substring(rooted, 1, NAME_LIMIT))


def sanitize_words(c: Column) -> Column:
    """``sanitize_identifier`` of every word of a text at once; a space ends a word, and all spaces stay."""
    # Each pattern begins with what is rare, so that most characters are passed by at once.
    white = r"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    text = F.regexp_replace(c, f"(?=[^ -~])(?:(?<![^ ]){white}++|(?<!{white}){white}++(?![^ ]))", "")
    text = F.regexp_replace(text, r"[^\w ]", "_")
    text = F.regexp_replace(text, "([0-9])(?<![^ ].)", "col_$1")
    return F.regexp_replace(text, rf"(^| )([^ ]{{{NAME_LIMIT}}})[^ ]+", "$1$2")


def file_stem(c: Column) -> Column:
    """File name without its last extension; a leading dot does not start an extension."""
    return F.regexp_replace(c, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def table_base_name(c: Column) -> Column:
    """Table name for a file name: timestamps at the end go, odd characters become underscores."""
    name = file_stem(c)
    for ending in FILE_TIMESTAMPS:
        name = F.regexp_replace(name, ending, "")
    name = F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")
    return (
        F.when(F.regexp_replace(name, "_", "") == "", F.lit(UNKNOWN_TABLE))
        .when(name.rlike(r"^[\p{L}_]"), name)
        .otherwise(F.concat(F.lit("t_"), name))
    )


def table_name_fallback(c: Column) -> Column:
    """Coarser table name: dates anywhere in the name go, runs of underscores collapse, lower case."""
    name = file_stem(c)
    for date in FALLBACK_DATES:
        name = F.regexp_replace(name, date, "")
    name = F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")
    return F.lower(F.btrim(F.regexp_replace(name, "_+", "_"), F.lit("_")))


def base_name(c: Column) -> Column:
    """Last part of a path."""
    return F.substring_index(c, "/", -1)


def file_key(path: Column) -> Column:
    """A path without scheme, as listings and approvals may write it either way."""
    return F.regexp_replace(path, "^[a-z0-9]+:/+", "/")


def sanitize_filename(c: Column) -> Column:
    return F.translate(base_name(c), UNSAFE_FILE_CHARS, "_" * len(UNSAFE_FILE_CHARS))


def timestamped_name(name: Column, at: Column) -> Column:
    """``name_yyyyMMdd_HHmmss.ext`` as used for archived and failed files."""
    stem = file_stem(name)
    extension = F.substring(name, F.length(stem) + 1, F.length(name))
    return F.concat(stem, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), extension)


def rotated_table_name(name: Column, at: Column) -> Column:
    """Name under which an incompatible backup table is set aside."""
    return F.concat(name, F.lit("_"), F.date_format(at, "yyyyMMddHHmmss"))
