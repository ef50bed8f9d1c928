"""Type names of table columns: one spelling for each, and which changes lose nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values --------------------------------------------------------------------------------------
# Types used where a name carries no size.
DEFAULT_VARCHAR = "varchar(4000)"
DEFAULT_NVARCHAR = "nvarchar(4000)"
DEFAULT_DECIMAL = "decimal(18,0)"
DEFAULT_CHAR = "char(1)"
# Length that says "no limit".
UNLIMITED = -1
# Conversions to a wider type.
WIDENINGS = {
    "int": ["bigint"],
    "smallint": ["int", "bigint"],
    "tinyint": ["smallint", "int", "bigint"],
    "float": ["real"],
    "datetime": ["datetime2"],
    "char": ["varchar", "nvarchar"],
    "varchar": ["nvarchar"],
}
# Widths of text columns: longest value seen, and the type given for it.
WIDTH_STEPS = [(500, "varchar(1024)"), (1000, "varchar(4000)"), (4000, "varchar(8000)")]
WIDTH_BEYOND = "varchar(MAX)"
WIDTH_EMPTY = "varchar(1024)"
# ---------------------------------------------------------------------------------------------------


def _sized(name: Column, word: str, length: Column, default: str) -> Column:
    stated = F.regexp_extract(name, rf"{word}\((\d+|max)\)", 1)
    return (
        F.when(length == UNLIMITED, F.lit(f"{word}(max)"))
        .when(length.isNotNull(), F.concat(F.lit(f"{word}("), length.cast("string"), F.lit(")")))
        .when(stated != "", F.concat(F.lit(f"{word}("), stated, F.lit(")")))
        .otherwise(F.lit(default))
    )


def canonical_type(name: Column, length: Column, precision: Column, scale: Column) -> Column:
    """Type name with its size in one spelling, from a name and the sizes of a column description."""
    low = F.lower(strip_blank(name))
    digits = r"(decimal|numeric)\((\d+),(\d+)\)"
    stated = F.regexp_extract(low, digits, 0)
    char_size = F.regexp_extract(low, r"char\((\d+)\)", 1)
    decimal = (
        F.when(
            precision.isNotNull() & scale.isNotNull(),
            F.concat(F.lit("decimal("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")),
        )
        .when(stated != "", stated)
        .otherwise(F.lit(DEFAULT_DECIMAL))
    )
    char = (
        F.when(length.isNotNull(), F.concat(F.lit("char("), length.cast("string"), F.lit(")")))
        .when(char_size != "", F.concat(F.lit("char("), char_size, F.lit(")")))
        .otherwise(F.lit(DEFAULT_CHAR))
    )
    return (
        F.when(low.startswith("varchar"), _sized(low, "varchar", length, DEFAULT_VARCHAR))
        .when(low.startswith("nvarchar"), _sized(low, "nvarchar", length, DEFAULT_NVARCHAR))
        .when(low.startswith("decimal") | low.startswith("numeric"), decimal)
        .when(low.startswith("char"), char)
        .otherwise(low)
    )


def strip_blank(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\r\n"))


def is_safe_widening(old: Column, new: Column) -> Column:
    """Whether a column of canonical type ``old`` may become ``new`` without losing data."""
    size = r"varchar\((\d+)\)"
    old_size, new_size = F.regexp_extract(old, size, 1), F.regexp_extract(new, size, 1)
    both_text = old.contains("varchar") & new.contains("varchar")
    old_base, new_base = F.substring_index(old, "(", 1), F.substring_index(new, "(", 1)
    lattice = F.create_map(*[F.lit(x) for k, v in WIDENINGS.items() for x in (k, ",".join(v))])
    targets = F.split(F.coalesce(lattice[old_base], F.lit("")), ",")
    return (
        F.when(both_text & (old_size != "") & (new_size != ""), new_size.cast("long") >= old_size.cast("long"))
        .when(both_text & new.contains("max"), F.lit(True))
        .when(old_base == new_base, F.lit(True))
        .otherwise(F.array_contains(targets, new_base))
    )


def width_bucket(longest: Column) -> Column:
    """Text type for the longest value of a column; NULL or 0 means that no value was seen."""
    result = F.when(longest.isNull() | (longest == 0), F.lit(WIDTH_EMPTY))
    for limit, name in WIDTH_STEPS:
        result = result.when(longest <= limit, F.lit(name))
    return result.otherwise(F.lit(WIDTH_BEYOND))
