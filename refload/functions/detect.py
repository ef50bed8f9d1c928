"""Format of delimited text, found from the text itself.

Each file is one row. The expensive parts (the line array, the field arrays) are made once in an earlier
``select`` and reused, so one pass over the rows answers every question and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refload.functions.cells import classify_cell, field_count, parse_fields
from refload.functions.text import is_blank, strip

# Fixed values --------------------------------------------------------------------------------------
# Candidate column delimiters; the first wins a tie.
DELIMITERS = [",", ";", "|", "\t"]
# Text qualifiers that are found; none is an empty text.
QUALIFIERS = ['"', "'", ""]
# Lines whose fields are shown with a format.
SHOWN_LINES = 3
# Words that show that a first line names columns, and the share of columns that must hold one.
HEADER_WORDS = ["id", "name", "date", "time", "code", "description", "value", "amount"]
HEADER_SHARE = 0.3
# Confidence: base, share for an even delimiter count, share for balanced quotes.
CONFIDENCE_BASE = 0.5
CONFIDENCE_EVEN = 0.3
CONFIDENCE_QUOTES = 0.2
# Errors, and the format assumed where there is one.
EMPTY_FILE = "File appears to be empty"
ONE_LINE = "File must have at least 2 lines for detection"
DEFAULT_FORMAT = {"column_delimiter": ",", "row_delimiter": "\n", "text_qualifier": '"'}
# Names of encodings.
ENCODING_ASCII = "ascii"
ENCODING_UTF8 = "utf-8"
ENCODING_UTF8_BOM = "UTF-8-SIG"
ENCODING_UTF16 = "UTF-16"
ENCODING_UTF32 = "UTF-32"
ENCODING_LATIN = "ISO-8859-1"
ENCODING_WINDOWS = "Windows-1252"
# ---------------------------------------------------------------------------------------------------


# What the bytes 80 to 9F are in Windows-1252; five of them are nothing and stay control characters.
WINDOWS_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS_CHARACTERS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def detect_encoding(content: Column) -> Column:
    """Encoding of a file's bytes: byte order mark, then UTF-8 validity, then one of two byte encodings."""
    mark = F.hex(F.substring(content, 1, 4))
    latin = F.decode(content, "ISO-8859-1")
    return (
        F.when(mark.startswith("EFBBBF"), F.lit(ENCODING_UTF8_BOM))
        .when((mark == "FFFE0000") | (mark == "0000FEFF"), F.lit(ENCODING_UTF32))
        .when(mark.startswith("FFFE") | mark.startswith("FEFF"), F.lit(ENCODING_UTF16))
        .when(~latin.rlike(r"[^\x00-\x7f]"), F.lit(ENCODING_ASCII))
        .when(F.is_valid_utf8(content.cast("string")), F.lit(ENCODING_UTF8))
        .when(latin.rlike(r"[\x80-\x9f]"), F.lit(ENCODING_WINDOWS))
        .otherwise(F.lit(ENCODING_LATIN))
    )


def decode_content(content: Column, encoding: Column) -> Column:
    """Text of a file's bytes in the detected encoding, without the byte order mark."""
    as_utf8 = F.make_valid_utf8(content.cast("string"))
    latin = F.decode(content, "ISO-8859-1")
    return (
        F.when(encoding == ENCODING_UTF16, F.decode(content, "UTF-16"))
        .when(encoding == ENCODING_UTF32, F.decode(content, "UTF-32"))
        .when(encoding == ENCODING_LATIN, latin)
        .when(encoding == ENCODING_WINDOWS, F.translate(latin, WINDOWS_CONTROLS, WINDOWS_CHARACTERS))
        .when(encoding == ENCODING_UTF8_BOM, F.regexp_replace(as_utf8, "^﻿", ""))
        .otherwise(as_utf8)
    )


def split_lines(text: Column) -> Column:
    """Lines of a text; CRLF and CR end a line as LF does."""
    feeds = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.split(feeds, "\n", -1)


def _occurrences(text: Column, piece: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))


def delimiter_counts(head: Column, delimiter: str) -> Column:
    """Occurrences of a delimiter in each of the first lines."""
    return F.transform(head, lambda x: _occurrences(x, delimiter))


def evenness(counts: Column) -> Column:
    """1 where every line has the same count, falling towards 0 as counts differ."""
    high, low = F.array_max(counts), F.array_min(counts)
    return F.lit(1.0) - (high - low) / (high + 1)


def delimiter_score(counts: Column) -> Column:
    """Mean count, weighed by how even the counts are; NULL without a line to judge by."""
    total = F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(counts) > 0, total / F.size(counts) * evenness(counts))


def _of_delimiter(chosen: Column, choices: list[Column]) -> Column:
    """The entry of ``choices`` that belongs to the chosen delimiter."""
    result = F.when(chosen == DELIMITERS[0], choices[0])
    for delimiter, choice in zip(DELIMITERS[1:], choices[1:], strict=True):
        result = result.when(chosen == delimiter, choice)
    return result


def _of_format(delimiter: Column, quote: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use(delimiter, quote)`` with fixed texts for those that are found.

    Patterns made of fixed texts are compiled once a task; made of columns, they are compiled anew wherever a file has
    another format than the one before.
    """
    result = F
    for d in DELIMITERS:
        for q in QUALIFIERS:
            result = result.when((delimiter == d) & (quote == q), use(F.lit(d), F.lit(q)))
    return result.otherwise(use(delimiter, quote))


def pick_delimiter(scores: list[Column]) -> Column:
    """Delimiter of the best score; the first candidate wins a tie and stands where nothing can be judged."""
    best = F.greatest(*scores)
    result = F.when(best.isNull(), F.lit(DELIMITERS[0]))
    for delimiter, score in zip(DELIMITERS, scores, strict=True):
        result = result.when(score == best, F.lit(delimiter))
    return result


def detect_row_delimiter(text: Column) -> Column:
    """Most frequent line ending; CRLF wins a tie, then LF; LF where there is none."""
    pairs = (F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2
    feeds = _occurrences(text, "\n") - pairs
    returns = _occurrences(text, "\r") - pairs
    return (
        F.when((pairs > 0) & (pairs >= feeds) & (pairs >= returns), F.lit("\r\n"))
        .when((feeds > 0) & (feeds >= returns), F.lit("\n"))
        .when(returns > 0, F.lit("\r"))
        .otherwise(F.lit("\n"))
    )


def quote_matches(text: Column, delimiter: Column, quote: str) -> Column:
    """Quoted pieces that follow a delimiter or start a line."""
    run = f"{quote}[^{quote}]*{quote}"
    after = _of_delimiter(delimiter, [F.regexp_count(text, F.lit(f"[{d}]{run}")) for d in DELIMITERS])
    return F.when(~F.contains(text, F.lit(quote)), F.lit(0)).otherwise(after + F.regexp_count(text, F.lit(f"(?md)^{run}")))


def pick_qualifier(text: Column, delimiter: Column, doubles: Column, singles: Column) -> Column:
    """Double quotes need a strict majority; with no quote at all they stand if the delimiter occurs."""
    return (
        F.when(doubles > singles, F.lit('"'))
        .when(singles > 0, F.lit("'"))
        .when(F.contains(text, delimiter), F.lit('"'))
        .otherwise(F.lit(""))
    )


def has_header(first: Column, second: Column) -> Column:
    """Whether the first of two rows of fields names the columns."""
    first_kinds = F.transform(first, classify_cell)
    second_kinds = F.transform(second, classify_cell)
    all_text = F.forall(first_kinds, lambda k: k == "string")
    number_below = F.exists(second_kinds, lambda k: k == "number")
    # Only A-Z become the letters of these words in lower case, and texts in other letters are slow to lower.
    named = F.size(F.filter(first, lambda cell: cell.rlike(f"(?i){'|'.join(HEADER_WORDS)}")))
    return (F.size(first) != F.size(second)) | (all_text & number_below) | (named > F.size(first) * F.lit(HEADER_SHARE))


def typical_width(widths: Column) -> Column:
    """Most frequent of an array of widths; the one seen first wins a tie."""
    counted = F.transform(
        F.array_distinct(widths),
        lambda w: F.struct(F.size(F.filter(widths, lambda x: x == w)).alias("n"), w.alias("w")),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("w"))
    return F.aggregate(counted, start, lambda acc, x: F.when(x["n"] > acc["n"], x).otherwise(acc))["w"]


def typical_lines(filled: Column, headed: Column) -> Column:
    """Those of the data lines that are compared: all between the header and the last line."""
    skipped = headed.cast("int")
    return F.slice(filled, skipped + 1, F.greatest(F.size(filled) - 1 - skipped, F.lit(0)))


def with_lines(df: DataFrame, content: str, scored_lines: int | None = None) -> DataFrame:
    """Add ``lines``, ``filled`` (those that are not blank) and ``head`` (those that the delimiter is judged by).

    All filled lines are judged, or with ``scored_lines`` the filled ones among so many first lines.
    """
    out = df.withColumn("lines", split_lines(F.col(content))).withColumn("filled", F.filter("lines", lambda x: ~is_blank(x)))
    if scored_lines is None:
        return out.withColumn("head", F.col("filled"))
    return out.withColumn("head", F.filter(F.slice("lines", 1, scored_lines), lambda x: ~is_blank(x)))


def with_delimiter(df: DataFrame) -> DataFrame:
    """Add one score per candidate, ``column_delimiter`` and ``evenness``; needs ``head``."""
    counts = df.withColumns({f"count_{i}": delimiter_counts(F.col("head"), d) for i, d in enumerate(DELIMITERS)})
    scored = counts.withColumns({f"score_{i}": delimiter_score(F.col(f"count_{i}")) for i in range(len(DELIMITERS))})
    picked = scored.withColumn("column_delimiter", pick_delimiter([F.col(f"score_{i}") for i in range(len(DELIMITERS))]))
    even = _of_delimiter(F.col("column_delimiter"), [evenness(F.col(f"count_{i}")) for i in range(len(DELIMITERS))])
    return picked.withColumn("evenness", even).drop(*[f"count_{i}" for i in range(len(DELIMITERS))])


def with_qualifier(df: DataFrame, content: str) -> DataFrame:
    """Add ``text_qualifier``; needs ``column_delimiter``."""
    text, delimiter = F.col(content), F.col("column_delimiter")
    counted = df.withColumns(
        {"doubles": quote_matches(text, delimiter, '"'), "singles": quote_matches(text, delimiter, "'")}
    )
    return counted.withColumn("text_qualifier", pick_qualifier(text, delimiter, F.col("doubles"), F.col("singles")))


def with_header(df: DataFrame) -> DataFrame:
    """Add ``has_header``; needs the lines, the delimiter and the qualifier."""
    delimiter, quote = F.col("column_delimiter"), F.col("text_qualifier")
    rows = df.withColumns(
        {
            f"{place}_row": _of_format(delimiter, quote, partial(parse_fields, F.get("lines", F.lit(i))))
            for i, place in enumerate(("first", "second"))
        }
    )
    headed = F.when(F.size("lines") < 2, F.lit(True)).otherwise(has_header(F.col("first_row"), F.col("second_row")))
    return rows.withColumn("has_header", headed)


def with_trailer(df: DataFrame) -> DataFrame:
    """Add ``typical_width``, ``has_trailer`` and ``trailer_line``; needs the header verdict."""
    delimiter, quote = F.col("column_delimiter"), F.col("text_qualifier")
    widths = _of_format(delimiter, quote, lambda d, q: F.transform("filled", lambda x: field_count(x, d, q)))
    measured = (
        df.withColumn("filled_widths", widths)
        .withColumns(
            {
                "line_widths": typical_lines(F.col("filled_widths"), F.col("has_header")),
                "last_width": F.get("filled_widths", F.size("filled_widths") - 1),
                "prev_width": F.get("filled_widths", F.size("filled_widths") - 2),
            }
        )
        .withColumn("typical_width", typical_width(F.col("line_widths")))
        .drop("filled_widths")
    )
    differs = (F.size("filled") >= 2) & (F.col("last_width") != F.col("prev_width"))
    regular = F.col("typical_width").isNull() | (F.col("prev_width") == F.col("typical_width"))
    return measured.withColumn("has_trailer", F.coalesce(differs & regular, F.lit(False))).withColumn(
        "trailer_line", F.when(F.col("has_trailer"), F.get("filled", F.size("filled") - 1))
    )


def detection_confidence(text: Column, even: Column, quote: Column) -> Column:
    """Between 0.5 and 1: higher for even delimiter counts and for balanced quotes."""
    quotes = F.length(text) - F.length(F.replace(text, quote, F.lit("")))
    balanced = F.when((quote != "") & (quotes % 2 == 0), F.lit(CONFIDENCE_QUOTES)).otherwise(F.lit(0.0))
    score = F.lit(CONFIDENCE_BASE) + F.coalesce(even * CONFIDENCE_EVEN, F.lit(0.0)) + balanced
    return F.least(score, F.lit(1.0))


def sample_rows(df: DataFrame) -> Column:
    """Fields of the first lines that are not blank; as many lines as are shown."""
    shown = F.slice("head", 1, SHOWN_LINES)
    return F.transform(shown, lambda x: parse_fields(x, F.col("column_delimiter"), F.col("text_qualifier")))


def detect_format(df: DataFrame, content: str, scored_lines: int | None = None) -> DataFrame:
    """Add every format column to a relation of one row per file with its whole text.

    The number of columns is the usual width of the data lines, or that of the first line where there are none.

    A file that cannot be judged keeps its row: it gets the default format, confidence 0 and ``error``.
    """
    kept = df.columns
    text = F.col(content)
    steps = with_trailer(with_header(with_qualifier(with_delimiter(with_lines(df, content, scored_lines)), content)))
    steps = steps.withColumn("sample", sample_rows(steps))
    error = F.when(text.isNull() | (strip(text) == ""), F.lit(EMPTY_FILE)).when(F.size("lines") < 2, F.lit(ONE_LINE))
    steps = steps.withColumn("error", error)
    bad = F.col("error").isNotNull()

    def unless_bad(value: Column, default: object = None) -> Column:
        return F.when(bad, F.lit(default)).otherwise(value)

    return steps.select(
        *kept,
        unless_bad(F.col("column_delimiter"), DEFAULT_FORMAT["column_delimiter"]).alias("column_delimiter"),
        unless_bad(detect_row_delimiter(text), DEFAULT_FORMAT["row_delimiter"]).alias("row_delimiter"),
        unless_bad(F.col("text_qualifier"), DEFAULT_FORMAT["text_qualifier"]).alias("text_qualifier"),
        unless_bad(F.col("has_header"), True).alias("has_header"),
        unless_bad(F.col("has_trailer"), False).alias("has_trailer"),
        F.when(~bad, F.col("trailer_line")).alias("trailer_line"),
        unless_bad(F.coalesce("typical_width", F.size(F.get("sample", F.lit(0))), F.lit(0))).alias("estimated_columns"),
        F.when(~bad, F.size("lines")).alias("sample_rows"),
        unless_bad(detection_confidence(text, F.col("evenness"), F.col("text_qualifier")), 0.0).alias(
            "detection_confidence"
        ),
        F.when(~bad, F.col("sample")).alias("sample_data"),
        unless_bad(F.col("column_delimiter"), DEFAULT_FORMAT["column_delimiter"]).alias("header_delimiter"),
        F.lit(0).alias("skip_lines"),
        "error",
    )
