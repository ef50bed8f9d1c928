"""Fields of one delimited line and the class of one cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refload.functions.text import strip

# Fixed values --------------------------------------------------------------------------------------
# Digits that are no decimal digits: superscripts, subscripts, circled and the like.
OTHER_DIGITS = (
    "²³¹፩-፱᧚⁰⁴-⁹₀-₉"
    "①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿"
    "❶-❾➀-➈➊-➒"
)
DATE_START = r"^\d{4}-\d{2}-\d{2}"
# ---------------------------------------------------------------------------------------------------

ALL_DIGITS = rf"^[\p{{Nd}}{OTHER_DIGITS}]+$"


def classify_cell(c: Column) -> Column:
    """``empty``, ``number``, ``date`` or ``string``; a bare ISO date counts as a number."""
    text = strip(c)
    return (
        F.when(text == "", F.lit("empty"))
        .when(F.translate(text, ".-+", "").rlike(ALL_DIGITS), F.lit("number"))
        .when(text.rlike(DATE_START), F.lit("date"))
        .otherwise(F.lit("string"))
    )


def quoted_run(quote: Column) -> Column:
    """Pattern for a quoted piece with doubled quotes inside; the closing quote may be missing.

    The repeated group is possessive: it never has to give a pair back, and the matcher then loops instead of
    calling itself once per pair.
    """
    return F.concat(
        quote, F.lit("[^"), quote, F.lit("]*(?:"), quote, quote, F.lit("[^"), quote, F.lit("]*)*+"), quote, F.lit("?")
    )


def _unquoted(line: Column, quote: Column) -> Column:
    """Whether a line is cut at every delimiter: no quote is set, or none occurs."""
    return (quote == "") | ~F.contains(line, quote)


def field_count(line: Column, delimiter: Column, quote: Column) -> Column:
    """Number of fields of a line; delimiters inside a quoted field do not count."""
    opened = F.concat(F.lit("(^|["), delimiter, F.lit("])"), quoted_run(quote))
    bare = F.when(_unquoted(line, quote), line).otherwise(F.regexp_replace(line, opened, F.lit("$1")))
    delimiters = F.length(bare) - F.length(F.replace(bare, delimiter, F.lit("")))
    return F.when(line == "", F.lit(0)).otherwise(delimiters + 1)


def parse_fields(line: Column, delimiter: Column, quote: Column) -> Column:
    """Fields of a line as an array, quotes removed and doubled quotes undone."""
    plain = F.concat(F.lit("[^"), delimiter, F.lit("]*"))
    piece = F.concat(
        F.lit("["), delimiter, F.lit("]("), quoted_run(quote), plain, F.lit("|"), plain, F.lit(")")
    )
    inside = F.concat(F.lit("(?s)^"), F.regexp_replace(quoted_run(quote), r"^(.)(.*)(.\?)$", "$1($2)$3"), F.lit("(.*)$"))

    def part(field: Column, group: int) -> Column:
        return F.call_function("regexp_extract", field, inside, F.lit(group))

    def unquote(field: Column) -> Column:
        body = F.replace(part(field, 1), F.concat(quote, quote), quote)
        return F.when(field.startswith(quote), F.concat(body, part(field, 2))).otherwise(field)

    quoted = F.transform(F.regexp_extract_all(F.concat(delimiter, line), piece, F.lit(1)), unquote)
    split = F.split(line, F.concat(F.lit("["), delimiter, F.lit("]")))
    return (
        F.when(line == "", F.array().cast("array<string>")).when(_unquoted(line, quote), split).otherwise(quoted)
    )
