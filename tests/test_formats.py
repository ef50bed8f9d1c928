"""Format detection on the small file corpus."""

from __future__ import annotations

import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refload.functions.cells import classify_cell, field_count, parse_fields
from refload.functions.detect import (
    HEADER_WORDS,
    decode_content,
    detect_encoding,
    detect_format,
    detect_row_delimiter,
    has_header,
    with_delimiter,
    with_header,
    with_lines,
    with_qualifier,
    with_trailer,
)

CASES = {
    "simple": ("id,name,value\n1,Test Item,100\n2,Sample Item,200\n", dict(column_delimiter=",", has_header=True, has_trailer=False)),
    "complex": (
        "id;description;category;price;date\n1;a;b;9.5;2024-01-01\n2;c;d;1.5;2024-01-02\n",
        dict(column_delimiter=";", has_header=True),
    ),
    "trailer_fewer": (
        "col1,col2,col3\nval1,val2,val3\nval4,val5,val6\nTOTAL,100\n",
        dict(has_trailer=True, trailer_line="TOTAL,100"),
    ),
    "trailer_one_field": (
        "name,age,city\nJohn,25,NYC\nJane,30,LA\nTOTAL RECORDS: 2",
        dict(has_trailer=True, trailer_line="TOTAL RECORDS: 2"),
    ),
    "trailer_after_same_width": (
        "id,name,amount\n1,a,5\n2,b,6\nTOTAL,Sum,500\nEND\n",
        dict(has_trailer=True, trailer_line="END"),
    ),
    "no_trailer": ("a,b,c\n1,2,3\n4,5,6\n", dict(has_trailer=False, trailer_line=None)),
    "blank_lines_at_end": ("c1,c2,c3\nv1,v2,v3\n\n  \nTOTAL,100\n\n", dict(has_trailer=True, trailer_line="TOTAL,100")),
    "empty": ("", dict(error="File appears to be empty", detection_confidence=0.0, column_delimiter=",")),
    "white": ("   \t  \n  \n  \t  ", dict(error="File appears to be empty")),
    "one_line": ("col1,col2,col3", dict(error="File must have at least 2 lines for detection")),
    "delimiter_tie": ("a,b;c\na,b;c\na,b;c", dict(column_delimiter=",")),
    "no_delimiter": ("free text\nmore text\nlast text", dict(column_delimiter=",", text_qualifier="", has_trailer=False)),
    "mixed_quotes": ("name,value\n\"John\",1\n'Jane',2\nBob,3", dict(text_qualifier="'")),
    "crlf": ("col1,col2\r\nval1,val2\r\nval3,val4", dict(row_delimiter="\r\n", column_delimiter=",", estimated_columns=2)),
    "numbers_first": ("123,456,789\nabc,def,ghi\n", dict(has_header=False)),
    "fully_quoted": ('"name","age","city"\n"John","25","NYC"\n', dict(text_qualifier='"', has_header=True)),
    "unclosed_quote": ('col1,col2,col3\nval1,val2,val3\n"unclosed,quote', dict(has_trailer=True)),
    "tabs": ("a\tb\n1\t2\n", dict(column_delimiter="\t")),
    "pipes": ("a|b|c\n1|2|3\n", dict(column_delimiter="|")),
}


@pytest.fixture(scope="module")
def detected(spark):
    rows = [(name, content) for name, (content, _) in CASES.items()]
    found = detect_format(spark.createDataFrame(rows, "name string, content string"), "content")
    return {r["name"]: r.asDict() for r in found.drop("content").collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_detect_format(detected, name):
    expected = CASES[name][1]
    assert {k: detected[name][k] for k in expected} == expected


def test_confidence_and_sample(detected):
    assert detected["simple"]["detection_confidence"] == pytest.approx(1.0)
    assert detected["simple"]["sample_data"][1] == ["1", "Test Item", "100"]


def test_row_delimiter_ties(spark):
    texts = {"a\r\nb\rc\nd": "\r\n", "a\rb\nc": "\n", "a\rb": "\r", "abc": "\n", "a\nb\nc\r\nd": "\n"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", detect_row_delimiter(F.col("t")).alias("d"))
    assert {r.t: r.d for r in rows.collect()} == texts


def test_classify_cell(spark):
    cells = {" ": "empty", "-1.5": "number", "2023-01-01": "number", "2023-01-01 10:00": "date", "x1": "string", "٣": "number", "-": "string"}
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", classify_cell(F.col("c")).alias("k"))
    assert {r.c: r.k for r in rows.collect()} == cells


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet='ab,;" \'', max_size=14), min_size=1, max_size=30))
def test_fields_like_the_csv_module(spark, lines):
    """Cutting a line agrees with the standard library for every quote and delimiter."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    combos = [(d, q) for d in ",;" for q in ('"', "'", "")]
    for d, q in combos:
        got = rows.select(
            "i",
            parse_fields(F.col("x"), F.lit(d), F.lit(q)).alias("f"),
            field_count(F.col("x"), F.lit(d), F.lit(q)).alias("n"),
        ).collect()
        for row in got:
            expected = next(csv.reader(io.StringIO(lines[row.i]), delimiter=d, quotechar=q or None), [])
            assert row.f == expected
            assert row.n == len(expected)


def test_encodings(spark):
    text = "Größe, naïve\nça va"
    files = {
        "utf-8": text.encode("utf-8"),
        "ascii": b"plain",
        "UTF-8-SIG": text.encode("utf-8-sig"),
        "UTF-16": text.encode("utf-16"),
        "ISO-8859-1": text.encode("iso-8859-1"),
    }
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "k string, content binary")
    coded = rows.withColumn("e", detect_encoding(F.col("content")))
    for row in coded.select("k", "e", decode_content(F.col("content"), F.col("e")).alias("t")).collect():
        assert row.e == row.k
        assert row.t == ("plain" if row.k == "ascii" else text)


def test_a_million_doubled_quotes(spark):
    """The matcher neither overflows its stack nor takes long."""
    cell = '"' + '""' * 1_000_000 + '"'
    rows = spark.createDataFrame([(f"a,b\n1,{cell}\n2,x\n",)], "t string")
    line = F.lit(f"1,{cell},y")
    cut = spark.range(1).select(parse_fields(line, F.lit(","), F.lit('"')).alias("f"), field_count(line, F.lit(","), F.lit('"')).alias("n"))
    row = cut.first()
    assert row.n == 3 and [len(x) for x in row.f] == [1, 1_000_000, 1]
    found = detect_format(rows, "t").drop("t").first()
    assert (found.column_delimiter, found.text_qualifier, found.estimated_columns) == (",", '"', 2)


def test_windows_characters(spark):
    text = "price: 5 € – “now”… Ž\x81"
    content = text.encode("cp1252", "surrogateescape") if "\x81" not in text else text[:-1].encode("cp1252") + b"\x81"
    row = spark.createDataFrame([(bytearray(content),)], "content binary").withColumn("e", detect_encoding(F.col("content")))
    got = row.select("e", decode_content(F.col("content"), F.col("e")).alias("t")).first()
    assert (got.e, got.t) == ("Windows-1252", text)


def test_formats_are_judged_by_whole_files(spark):
    """A delimiter that only later lines show, and widths beyond the first hundred lines."""
    late = "a b\n" * 12 + "1;2;3;4;5;6;7;8\n" * 300
    wide = "x,y\n" + "1,2\n" * 110 + "1,2,3\n" * 400 + "1,2,3\nTOTAL,7\n"
    rows = spark.createDataFrame([("late", late), ("wide", wide)], "k string, t string")
    found = {r.k: r for r in detect_format(rows, "t").drop("t").collect()}
    assert found["late"].column_delimiter == ";"
    assert found["wide"].estimated_columns == 3 and found["wide"].has_trailer
    first = detect_format(rows, "t", scored_lines=10).drop("t").where("k = 'late'").first()
    assert first.column_delimiter == ","


def formats_of(rows: list[tuple[str, str, str]]) -> list[str]:
    """Formats in turn, as a table of small files has them."""
    return [f"{a}{d}{q}{b}{d}x{q}{d}{c}" for a, b, c in rows for d in (",", ";", "|", "\t") for q in ('"', "'", "")]


def test_patterns_are_fixed_texts(spark):
    """Patterns made of columns were compiled anew for every line of a file whose format differed from the one before."""
    files = spark.createDataFrame([("a,b\n1,2\n",)], "content string").repartition(1)
    steps = with_trailer(with_header(with_qualifier(with_delimiter(with_lines(files, "content")), "content")))
    whole = steps.select("has_trailer", "trailer_line")._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"(^|[{d}]){q}[^{q}]*" in whole for d in ",;|" for q in "\"'")


FIELDS = [("a", "b", "c"), ("", "b''b", "1"), ("a", 'b""b', ""), ("é", "", "2024-01-01")]


def test_widths_and_fields_of_mixed_formats(spark):
    """A line without the qualifier is cut at every delimiter, with the qualifier as its quoted fields say; any format may follow any other."""
    marks = [(d, q) for d in (",", ";", "|", "\t", "~") for q in ('"', "'", "")]
    lines = formats_of(FIELDS) + ["", "plain", "a,b", "a;'b;c", '"', "''", None]
    rows = spark.createDataFrame([(x, d, q) for x in lines for d, q in marks], "line string, d string, q string")
    found = rows.select(
        "line", "d", "q", field_count(F.col("line"), F.col("d"), F.col("q")).alias("n"), parse_fields(F.col("line"), F.col("d"), F.col("q")).alias("f")
    ).collect()

    def expected(line: str, d: str, q: str) -> list[str]:
        out, at = [], 0
        while at <= len(line):
            field, end = "", at
            if q and line.startswith(q, at):
                end = at + 1
                while end < len(line) and (line[end] != q or line.startswith(q + q, end)):
                    field += line[end]
                    end += 2 if line[end] == q else 1
                end = min(end + 1, len(line))
            stop = line.find(d, end)
            stop = len(line) if stop < 0 else stop
            out.append(field + line[end:stop])
            at = stop + 1
        return out

    for r in found:
        fields = None if r.line is None else expected(r.line, r.d, r.q) if r.line else []
        assert r.f == fields, (r.line, r.d, r.q)
        assert r.n == (None if fields is None else len(fields)), (r.line, r.d, r.q)


def test_header_words_in_any_case(spark):
    """Case counts for A-Z only: the dotted capital I and the Kelvin sign are in no header word."""
    first = ["ID", "Name", "DATE", "xTimex", "İD", "K", "valué", "VALUE", "", None]
    rows = spark.createDataFrame([([a, "z", "z"], ["b", "c", "d"]) for a in first], "a array<string>, b array<string>")
    found = [r.h for r in rows.select(has_header(F.col("a"), F.col("b")).alias("h")).collect()]
    lowered = [any(w in x.lower() for w in HEADER_WORDS) for x in first if x is not None]
    assert found[:-1] == lowered
