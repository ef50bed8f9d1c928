"""Names of tables and columns."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refload.functions.text import (
    WHITE_SPACE,
    clean_null_tokens,
    sanitize_filename,
    sanitize_identifier,
    sanitize_words,
    table_base_name,
)
from refload.operators.names import dedupe_header, dedupe_headers, dedupe_names
from refload.plans.queries.names import dedupe_names_query
from tests.conftest import SF


def apply(spark, function, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", function(F.col("t")).alias("r"))
    return {r.t: r.r for r in rows.collect()}


def test_table_base_name(spark):
    expected = {
        "users.csv": "users",
        "user_data_20241225.csv": "user_data",
        "Products-List_2024-12-25.csv": "Products_List_2024_12_25",
        "file_without_extension": "file_without_extension",
        "file.with.dots.csv": "file_with_dots",
        "UPPERCASE_FILE.CSV": "UPPERCASE_FILE",
        "abc.20240131.csv": "abc",
        "abc_20240131_101112.csv": "abc",
        "abc.20240131101112.csv": "abc",
        "abc.20240131.101112.csv": "abc",
        "": "unknown_table",
        "___.csv": "unknown_table",
        "9lives.csv": "t_9lives",
    }
    assert apply(spark, table_base_name, expected) == expected


def test_sanitize_identifier(spark):
    expected = {
        "invalid-column-name": "invalid_column_name",
        "123column": "col_123column",
        "column with spaces": "column_with_spaces",
        "normal": "normal",
        "  ": "",
        "é": "_",
        "x" * 150: "x" * 120,
    }
    assert apply(spark, sanitize_identifier, expected) == expected


def test_clean_null_tokens(spark):
    expected = {" a ": "a", "NULL": None, " NaN": None, "none\xa0": None, "": None, "nullable": "nullable"}
    assert apply(spark, clean_null_tokens, expected) == expected


def test_sanitize_filename(spark):
    expected = {"/tmp/a<b>c.csv": "a_b_c.csv", 'q"?.csv': "q__.csv"}
    assert apply(spark, sanitize_filename, expected) == expected


def one_by_one(names):
    """The rule spelled out, name after name."""
    counters, given_names, low = {}, [], set()
    for name in names:
        chosen = name
        if name and name.lower() in low:
            number = counters.get(name.lower(), 0) + 1
            while f"{name}_{number}".lower() in low:
                number += 1
            counters[name.lower()] = number
            chosen = f"{name}_{number}"
        given_names.append(chosen)
        low.add(chosen.lower())
    return given_names


headers = st.lists(st.sampled_from(["a", "A", "b", "a_1", "A_2", "a_2", "a_1_1", ""]), min_size=1, max_size=9)


@settings(max_examples=5, deadline=None)
@given(st.lists(headers, min_size=1, max_size=12))
def test_dedupe_both_ways(spark, files):
    """The walk over one header and the windows over a relation agree with the rule."""
    arrays = spark.createDataFrame([(i, names) for i, names in enumerate(files)], "f int, names array<string>")
    expected = {i: one_by_one(names) for i, names in enumerate(files)}
    walked = arrays.select("f", dedupe_header(F.col("names")).alias("u")).collect()
    assert {r.f: r.u for r in walked} == expected
    relation = arrays.select("f", F.posexplode("names").alias("p", "n"))
    rows = dedupe_names(relation, "f", "p", "n").orderBy("f", "p").collect()
    assert {i: [r.unique_name for r in rows if r.f == i] for i in expected} == expected


def test_dedupe_headers(spark):
    """Headers in one row each, a file in two rows (two names at a position, numbers that hit other names), no file, no header."""
    rows = [(1, ["a", "A", "a_1", "", "a", ""]), (2, ["É", "é", None, "é"]), (3, []), (4, None)]
    twice = [(5, ["x", "x_1", "x"]), (5, ["x", "x_1", "x"])]
    nobody = [(None, ["n", "n"]), (None, ["n", "n_1"])]
    given = spark.createDataFrame(rows + twice + nobody, "f long, names array<string>")
    found = dedupe_headers(given, "f", F.col("names")).collect()
    names = {f: [r.unique_name for r in sorted(found, key=lambda r: r.pos) if r.f == f] for f in (1, 2, 3, 4)}
    assert names == {1: ["a", "A_1", "a_1_1", "", "a_2", ""], 2: ["É", "é_1", None, "é_2"], 3: [], 4: []}
    assert [r.pos for r in sorted(found, key=lambda r: r.pos) if r.f == 5] == [0, 0, 1, 1, 2, 2]
    assert sorted(r.unique_name for r in found if r.f == 5) == sorted(one_by_one(["x", "x", "x_1", "x_1", "x", "x"]))
    assert sorted(r.unique_name for r in found if r.f is None) == ["n", "n_1", "n_1", "n_2"]


def test_rows_of_a_clashing_file_stay_as_many(spark):
    """A file whose positions come twice kept four rows for two where a numbered name hit another."""
    rows = [(1, p, n, e) for p, n in enumerate(["x", "x_1", "x"]) for e in ("left", "right")]
    columns = spark.createDataFrame(rows, "f long, p int, n string, extra string")
    found = dedupe_names(columns, "f", "p", "n").collect()
    assert sorted((r.p, r.n, r.extra) for r in found) == sorted((p, n, e) for _, p, n, e in rows)
    assert len({r.unique_name for r in found}) == 6


words = st.text(st.sampled_from([*WHITE_SPACE, *"  aB9_-é€😀"]), max_size=30)


@settings(max_examples=5, deadline=None)
@given(st.lists(words, min_size=1, max_size=200))
def test_sanitize_words(spark, texts):
    """A text at once, or word by word."""
    texts = [*texts, *(f"{b}{'x' * n}{b} {'9' * n}{a}" for n in (115, 116, 117, 119, 120, 121, 300) for a in ("", " ", "\t") for b in ("", "\n"))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    one = F.transform(F.split("t", " "), sanitize_identifier)
    found = rows.select("t", F.split(sanitize_words(F.col("t")), " ").alias("at_once"), one.alias("one")).collect()
    assert [r.t for r in found if r.at_once != r.one] == []


def test_words_are_not_shuffled(spark):
    """Texts are dealt out once, before they become words; the words of all texts were dealt out three times."""
    plan = dedupe_names_query(spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    ends = [next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan)) for i in range(len(plan))]
    dealt = [line for i, top in enumerate(plan) if "Exchange" in top for line in plan[i + 1 : ends[i]]]
    assert dealt and not [line for line in dealt if "Generate" in line]
