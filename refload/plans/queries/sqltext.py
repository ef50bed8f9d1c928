"""Pieces of SQL that several queries share."""

from __future__ import annotations

from refload.functions.text import NULL_TOKENS, WHITE_SPACE


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_strip(x: str) -> str:
    return f"trim({x}, '{WHITE_SPACE}')"


def sql_clean(x: str) -> str:
    return f"CASE WHEN lower({sql_strip(x)}) IN {sql_list(NULL_TOKENS)} THEN NULL ELSE {sql_strip(x)} END"


def sql_sanitize(x: str) -> str:
    plain = f"regexp_replace({sql_strip(x)}, '[^a-zA-Z0-9_]', '_', 'g')"
    return (
        f"CASE WHEN {x} IS NULL OR {sql_strip(x)} = '' THEN '' "
        f"WHEN regexp_matches({plain}, '^[A-Za-z_]') THEN substr({plain}, 1, 120) "
        f"ELSE substr('col_' || {plain}, 1, 120) END"
    )


def sql_stem(x: str) -> str:
    return rf"regexp_replace({x}, '(?s)^(\.*[^.].*)\.[^.]*$', '\1')"


def sql_stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def sql_classify(x: str, digits: str, date: str) -> str:
    text = sql_strip(x)
    return (
        f"CASE WHEN {text} = '' THEN 'empty' "
        f"WHEN regexp_matches(translate({text}, '.-+', ''), '{digits}') THEN 'number' "
        f"WHEN regexp_matches({text}, '{date}') THEN 'date' ELSE 'string' END"
    )
