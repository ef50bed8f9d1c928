"""Files of any size: both ways of profiling find the same format, and none is passed over."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from refload.session import new_folder
from refload.sources.profiles import file_formats, spanning_matches, wide_records
from refload.streaming.dropfolder import stream_dropfolder
from tests.test_formats import CASES


def listing(spark, folder):
    return spark.read.format("binaryFile").load(str(folder)).select("path", "modificationTime", "length")


def formats(spark, folder, whole_bytes):
    found = file_formats(spark, listing(spark, folder), whole_bytes).collect()
    return {r.path.rsplit("/", 1)[1]: r.asDict() for r in found}


def test_lines_and_whole_files_agree(spark, tmp_path):
    for name, (content, _) in CASES.items():
        (tmp_path / name).write_bytes(content.encode())
    made = random.Random(4)
    for i in range(25):
        d, q, eol = made.choice(",;|\t"), made.choice(["", '"', "'"]), made.choice(["\n", "\r\n", "\r"])
        rows = [[q + made.choice(["id", "x y", "7", "2024-01-01", "", f"a{d}b" if q else "ab"]) + q for _ in range(3)] for _ in range(made.randint(1, 40))]
        text = eol.join(d.join(r) for r in rows) + made.choice(["", eol, eol * 2, f"{eol}TOTAL{d}9"])
        (tmp_path / f"r{i}").write_bytes(text.encode())
    (tmp_path / "latin").write_bytes("id;größe\n1;ü\n2;ö\n".encode("latin-1"))
    (tmp_path / "windows").write_bytes("id;preis\n1;5 €\n2;6 €\n".encode("cp1252"))
    (tmp_path / "mark").write_bytes("id;v\n1;ü\n2;ö\n".encode("utf-8-sig"))
    whole, lines = formats(spark, tmp_path, 10**9), formats(spark, tmp_path, -1)
    assert set(whole) == set(lines)
    for name, want in whole.items():
        assert lines[name] == want, name


MARKS = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff", "utf-32-le": b"\xff\xfe\0\0", "utf-32-be": b"\0\0\xfe\xff"}


def test_wide_encodings_agree(spark, tmp_path):
    """UTF-16 and UTF-32 of both byte orders and all line ends, in parts and whole."""
    texts = {"trailer": "id;größe;x{0}1;ü;2{0}2;ö;3{0}3;ä;4{0}TOTAL;3{0}", "open": "id,v{0}1,'a'{0}2,'b'", "blank": " {0}{0}", "one": "a,b", "mixed": "a|b\r1|2\n3|4{0}5|6\r"}
    for code, mark in MARKS.items():
        for name, text in texts.items():
            for eol, end in (("lf", "\n"), ("crlf", "\r\n"), ("cr", "\r")):
                (tmp_path / f"{code} {name} {eol}").write_bytes(mark + text.format(end).encode(code))
        (tmp_path / f"{code} mark").write_bytes(mark)
    whole, lines = formats(spark, tmp_path, 10**9), formats(spark, tmp_path, -1)
    assert set(whole) == set(lines) and len(whole) == 64
    for name, want in whole.items():
        assert lines[name] == want, name


def test_line_feeds_off_the_grid(spark, tmp_path):
    """Characters that make the bytes of a line feed between them cut nothing, in whatever splits a file is read."""
    made = random.Random(7)
    signs = ["\u0a05", "\u0100", "\u0a0a", "\u0200", "\u000a", "x", "\u0a00", "\U00010a05"]
    for code, mark in MARKS.items():
        for i in range(3):
            text = "".join(made.choice(signs) for _ in range(400))
            (tmp_path / f"{code}-{i}").write_bytes(mark + text.encode(code))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150b")
    try:
        for code, mark in MARKS.items():
            paths = [str(tmp_path / f"{code}-{i}") for i in range(3)]
            got = wide_records(spark, paths, mark.hex().upper()).orderBy("path", "block", "at").collect()
            for i, path in enumerate(paths):
                with open(path, "rb") as file:
                    want = file.read().decode(code).split("\n")
                mine = [bytes(r.bytes).decode(code) for r in got if r.path.endswith(f"{code}-{i}")]
                assert mine == (want if want[-1] else want[:-1]), path
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quoted_pieces_over_line_ends(spark, tmp_path):
    """Pieces that reach over lines and blocks count as in one text."""
    made = random.Random(11)
    rows, want = [], {}
    for i in range(40):
        text = "".join(made.choice(["\"", "'", ",", "\n", "a", ",\"", "\n'"]) for _ in range(made.randint(1, 80)))
        counts = []
        for q in "\"'":
            run = f"{q}[^{q}]*{q}"
            counts.append(len(re.findall(f"[,]{run}", text)) + len(re.findall(f"(?m)^{run}", text)))
        want[str(i)] = tuple(counts)
        lines, block = text.split("\n"), 0
        for at, line in enumerate(lines):
            block += made.random() < 0.3
            rows.append((str(i), block, at, line))
    lines = spark.createDataFrame(rows, "path string, block long, at long, line string").selectExpr("path", "struct(block, at) place", "line")
    got = {r.path: (r.doubles, r.singles) for r in spanning_matches(lines, F.lit(",")).collect()}
    assert got == want
    cell = "\n".join(["id,note"] + [f"{i},'first\nsecond'" for i in range(30)] + ['31,"x"'])
    (tmp_path / "cells").write_text(cell)
    whole, parts = formats(spark, tmp_path, 10**9)["cells"], formats(spark, tmp_path, -1)["cells"]
    assert whole == parts and parts["text_qualifier"] == "'"


def test_every_dropped_file_gets_a_row(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "small.csv").write_text("id;v\n1;a\n2;b\nTOTAL;2\n")
    with open(folder / "large.csv", "w") as file:  # above 20 MiB
        file.write("id,name,amount\n")
        for i in range(0, 900_000, 10):
            file.write("".join(f"{i + k},name {i + k},{i}.50\n" for k in range(10)))
        file.write("TOTAL,900000\n")
    (folder / "blank.csv").write_text("  \n \n")
    registry = new_folder(spark, "formats")
    stream_dropfolder(spark, str(folder), registry, new_folder(spark, "checkpoint"), once=True).awaitTermination()
    found = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(registry).collect()}
    assert set(found) == {"small.csv", "large.csv", "blank.csv"}
    large = found["large.csv"]
    assert large.length > 20 * 1024 * 1024
    assert (large.column_delimiter, large.estimated_columns, large.has_header, large.trailer_line) == (",", 3, True, "TOTAL,900000")
    assert large.sample_rows == 900_003 and large.row_delimiter == "\n" and found["blank.csv"].error
    again = stream_dropfolder(spark, str(folder), registry, new_folder(spark, "checkpoint"), once=True)
    again.awaitTermination()
    assert spark.read.parquet(registry).where(F.col("error").isNull()).count() == 2
