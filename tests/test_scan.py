"""Reading delimited files: positions, trailers, ragged records."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from refload.session import materialize
from refload.sources.delimited import (
    FILE,
    DelimitedFormat,
    data_columns,
    drop_trailer,
    header_names,
    number_records,
    reject_ragged,
    scan_delimited,
    scan_records,
    skip_leading_lines,
)


def values(df):
    return sorted(tuple(r) for r in df.select(*data_columns(df)).collect())


def test_quotes_and_short_records(spark, write_file):
    path = write_file("q.csv", 'col1,col2,col3\n"value,with,commas","value""with""quotes",normal\na,,\nb,1\n')
    rows = scan_delimited(spark, path, DelimitedFormat())
    assert values(rows) == [("a", "", ""), ("b", "1", ""), ("value,with,commas", 'value"with"quotes', "normal")]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_ends(spark, write_file, end):
    path = write_file("e.csv", end.join(["a;b", "1;2", "3;4"]))
    fmt = DelimitedFormat(column_delimiter=";", row_delimiter=end)
    assert values(scan_records(spark, path, ["a", "b"], fmt)) == [("1", "2"), ("3", "4")]


def test_row_delimiter_spellings():
    separators = {"\n": None, "\\r\\n": None, '|""\\r\\n': None, "\\r": "\r", "xx": None}
    assert {k: DelimitedFormat(row_delimiter=k).line_separator for k in separators} == separators


def test_header_names(spark, write_file):
    path = write_file("h.csv", "# comment\na b,a b,,1st,A b_1\n")
    assert header_names(spark, path, DelimitedFormat(skip_lines=1)) == ["a_b", "a_b_1", "", "col_1st", "A_b_1_1"]


def test_skip_and_trailer(spark, write_file):
    path = write_file("t.csv", "made today\nid,name\n1,x\n2,y\nTRAILER: 2 records\n")
    fmt = DelimitedFormat(skip_lines=1, has_trailer=True)
    assert values(scan_delimited(spark, path, fmt)) == [("1", "x"), ("2", "y")]


def test_blank_header_is_dropped(spark, write_file):
    path = write_file("b.csv", "id,,name\n1,gone,x\n")
    rows = scan_delimited(spark, path, DelimitedFormat())
    assert data_columns(rows) == ["id", "name"] and values(rows) == [("1", "x")]


def test_quoted_line_breaks(spark, write_file):
    path = write_file("m.csv", 'id,text\n1,"two\nlines"\n2,one\n')
    fmt = DelimitedFormat(multi_line=True, has_trailer=True)
    assert values(scan_delimited(spark, path, fmt)) == [("1", "two\nlines")]


def test_numbering_over_many_splits(spark, write_file):
    """Files cut into many blocks are numbered as if read from the top."""
    files = {f"f{i}.csv": [f"{i}-{j}" for j in range(200 + 37 * i)] for i in range(4)}
    folder = None
    for name, lines in files.items():
        folder = write_file(name, "\n".join(lines) + "\n").rsplit("/", 1)[0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        records = materialize(scan_records(spark, folder, ["x"], DelimitedFormat(has_header=False)), "records")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert records.select(F.countDistinct("_block")).first()[0] > 5
    numbered = number_records(records)
    rows = numbered.select(F.regexp_extract(FILE, r"(f\d\.csv)", 1).alias("f"), "x", "_record", "_records").collect()
    assert {(r.f, r["_record"]): r.x for r in rows} == {(n, i): x for n, xs in files.items() for i, x in enumerate(xs)}
    assert all(r["_records"] == len(files[r.f]) for r in rows)
    kept = {r.x for r in drop_trailer(skip_leading_lines(numbered, 2)).select("x").collect()}
    assert kept == {x for xs in files.values() for x in xs[2:-1]}
    shorter = drop_trailer(records)
    assert sorted(r.x for r in shorter.collect()) == sorted(x for xs in files.values() for x in xs[:-1])
    assert "Window" not in shorter._jdf.queryExecution().executedPlan().toString()


def test_ragged_file_fails_alone(spark, write_file):
    write_file("good.csv", "a,b\n1,2\n3\n")
    folder = write_file("bad.csv", 'a,b\n1,2\n"x,y",4\n5,6,7\n').rsplit("/", 1)[0]
    records = scan_records(spark, folder, ["a", "b"], DelimitedFormat())
    kept, verdicts = reject_ragged(records, DelimitedFormat(), 2)
    assert values(kept) == [("1", "2"), ("3", "")]
    name = F.regexp_extract(FILE, r"(\w+)\.csv", 1).alias("f")
    got = {r.f: (r.records, r.long_records, r.short_records, r.accepted) for r in verdicts.select(name, "*").collect()}
    assert got == {"good": (2, 0, 1, True), "bad": (3, 1, 0, False)}


def test_other_columns_fail_the_scan(spark, write_file):
    write_file("1.csv", "a b,c\n1,2\n")
    folder = write_file("2.csv", "c,a b\n3,4\n").rsplit("/", 1)[0]
    with pytest.raises(Exception, match="header"):
        scan_delimited(spark, folder, DelimitedFormat()).collect()
    write_file("2.csv", "A B,C\n3,4\n")
    assert values(scan_delimited(spark, folder, DelimitedFormat())) == [("1", "2"), ("3", "4")]
