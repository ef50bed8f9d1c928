"""Formats of files of any size.

A small file is one row with its whole text. A large one is read line by line, in as many tasks as it has splits, and
everything that decides its format is an aggregate per file: counts, first and last lines, a histogram of widths. Files in
UTF-16 and UTF-32 are cut at their own, encoded line feeds. Both ways find the same format: quoted pieces that
reach over line ends count as in one text, by the state (in quotes or not) that every line begins in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refload.functions.cells import field_count, parse_fields
from refload.functions.detect import (
    CONFIDENCE_BASE,
    CONFIDENCE_EVEN,
    CONFIDENCE_QUOTES,
    DEFAULT_FORMAT,
    DELIMITERS,
    EMPTY_FILE,
    ENCODING_ASCII,
    ENCODING_LATIN,
    ENCODING_UTF8,
    ENCODING_UTF8_BOM,
    ENCODING_UTF16,
    ENCODING_UTF32,
    ENCODING_WINDOWS,
    ONE_LINE,
    decode_content,
    detect_encoding,
    detect_format,
    has_header,
    pick_delimiter,
    pick_qualifier,
    quote_matches,
)
from refload.functions.text import is_blank
from refload.session import materialize

# Bytes up to which a file is one row.
WHOLE_FILE_BYTES = 20 * 1024 * 1024
# Records beyond this are passed over when line feeds are counted: a file of other line ends is one record then.
LONGEST_RECORD = 16 * 1024 * 1024
# Byte order marks of encodings whose characters have several bytes, with name and bytes a unit.
WIDE_MARKS = {"FFFE0000": ("UTF-32LE", 4), "0000FEFF": ("UTF-32BE", 4), "FFFE": ("UTF-16LE", 2), "FEFF": ("UTF-16BE", 2)}


def profiled(files: DataFrame) -> DataFrame:
    """Files with encoding and format in place of their bytes (``content``)."""
    coded = files.withColumn("encoding", detect_encoding(F.col("content")))
    texts = coded.withColumn("text", decode_content(F.col("content"), F.col("encoding"))).drop("content")
    return detect_format(texts, "text").drop("text")


def file_formats(spark: SparkSession, listing: DataFrame, whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """Format of every file of a listing (``path, modificationTime, length``), one row each.

    Paths come to the driver, as many as the listing has; it is one trigger's worth of files.
    """
    paths = [(r.path, r.length) for r in listing.select("path", "length").collect()]
    small, large = [p for p, n in paths if n <= whole_bytes], [p for p, n in paths if n > whole_bytes]
    kept = ["path", "modificationTime", "length"]
    parts = []
    if small:
        parts.append(profiled(spark.read.format("binaryFile").load(small).select(*kept, "content")))
    if large:
        parts.append(line_formats(spark, large))
    if not parts:
        return profiled(listing.select(*kept).withColumn("content", F.lit(b"")).limit(0))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _line_encoding(lines: DataFrame) -> DataFrame:
    """Encoding of each file from its lines' bytes, by the order of rules that whole files are judged in."""
    latin = F.decode("bytes", "ISO-8859-1")
    seen = lines.groupBy("path").agg(
        F.hex(F.min_by(F.substring("bytes", 1, 4), "place")).alias("mark"),
        F.bool_or(latin.rlike(r"[^\x00-\x7f]")).alias("high"),
        F.bool_and(F.is_valid_utf8(F.col("bytes").cast("string"))).alias("valid"),
        F.bool_or(latin.rlike(r"[\x80-\x9f]")).alias("controls"),
    )
    mark = F.col("mark")
    encoding = (
        F.when(mark.startswith("EFBBBF"), F.lit(ENCODING_UTF8_BOM))
        .when((mark == "FFFE0000") | (mark == "0000FEFF"), F.lit(ENCODING_UTF32))
        .when(mark.startswith("FFFE") | mark.startswith("FEFF"), F.lit(ENCODING_UTF16))
        .when(~F.col("high"), F.lit(ENCODING_ASCII))
        .when(F.col("valid"), F.lit(ENCODING_UTF8))
        .when(F.col("controls"), F.lit(ENCODING_WINDOWS))
        .otherwise(F.lit(ENCODING_LATIN))
    )
    byte_order = reduce(lambda rest, m: F.when(mark.startswith(m), F.lit(m)).otherwise(rest), reversed(WIDE_MARKS), F.lit(None).cast("string"))
    return seen.select("path", encoding.alias("encoding"), byte_order.alias("byte_order"))


def _line_ends(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of each file between line feeds, their bytes, those that end with a return, and whether the last does."""
    reader = spark.read.option("mapreduce.input.linerecordreader.line.maxlength", LONGEST_RECORD)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = reader.text(paths, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), place.alias("place"), "value")
    pair = F.col("value").endswith("\r")
    return rows.groupBy("path").agg(
        F.count("*").alias("fed"), F.sum(F.octet_length("value")).alias("fed_bytes"), F.count_if(pair).alias("paired"),
        F.max_by(pair, "place").alias("last_paired"),
    )


def _summed_before(records: DataFrame, value: str) -> DataFrame:
    """Adds ``<value>_before``, the sum over the records of the file in front of this one: within blocks, and over blocks."""
    blocks = records.groupBy("path", "block").agg(F.sum(value).alias("own"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("path", "block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summed = records.withColumn("_sum", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts, ["path", "block"]).withColumn(f"{value}_before", F.col("start") + F.col("_sum")).drop("start", "_sum")


def wide_records(spark: SparkSession, paths: list[str], mark: str) -> DataFrame:
    """(path, block, at, bytes): what stands between the line feeds of files with one byte order mark, in any number of splits.

    The reader looks for the bytes of a line feed wherever they stand. Where they end one character and begin the next they
    are no line feed: they start off the grid of characters, which shows in the sum of all bytes in front. Such pieces are
    put together again.
    """
    name, width = WIDE_MARKS[mark]
    rows = spark.read.option("encoding", name).text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("bytes"),
    )
    rows = materialize(rows, "wide-records")
    off_grid = rows.where(F.octet_length("bytes") % width != 0).select("path").distinct()
    if off_grid.isEmpty():
        return rows
    torn = rows.join(off_grid, "path", "left_semi").withColumn("size", F.octet_length("bytes").cast("long") + width)
    torn = _summed_before(torn, "size")
    torn = torn.withColumn("ends", ((F.col("size_before") + F.col("size")) % width == 0).cast("long")).drop("size_before")
    torn = _summed_before(materialize(torn, "wide-torn"), "ends")
    pieces = F.array_sort(F.collect_list(F.struct("block", "at", F.hex("bytes").alias("hex"))))
    feed = "\n".encode(name).hex()
    whole = torn.groupBy("path", "ends_before").agg(pieces.alias("p")).select(
        "path", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["at"].alias("at"),
        F.unhex(F.array_join(F.transform("p", lambda x: x["hex"]), feed)).alias("bytes"),
    )
    return rows.join(off_grid, "path", "left_anti").unionByName(whole)


def _wide_lines(spark: SparkSession, paths: list[str], mark: str) -> tuple[DataFrame, DataFrame]:
    """Lines as ``line_formats`` reads them, in UTF-8, and per file what its line ends are, of files with one byte order mark."""
    name, width = WIDE_MARKS[mark]
    records = wide_records(spark, paths, mark)
    text = F.decode(F.concat(F.unhex(F.lit(mark)), F.col("bytes")), name[:6])
    first = records.groupBy("path").agg(F.min(F.struct("block", "at")).alias("first"))
    starts = F.struct("block", "at") == F.col("first")
    records = records.join(first, "path").withColumn("text", F.when(starts, F.regexp_replace(text, "^\ufeff", "")).otherwise(text))
    records = materialize(records.select("path", "block", "at", "text", F.octet_length("bytes").alias("size")), "wide-texts")
    parts = F.posexplode(F.split(F.regexp_replace("text", r"\r\z", ""), "\r", -1)).alias("part", "line")
    lines = records.select("path", "block", "at", parts)
    lines = lines.select("path", F.struct("block", "at", "part").alias("place"), F.col("line").cast("binary").alias("bytes"))
    pair = F.col("text").endswith("\r")
    ends = records.groupBy("path").agg(
        F.count("*").alias("records"), F.sum(F.col("size") + width).alias("all_bytes"), F.count_if(pair).alias("w_pairs"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\r"), F.lit("")))).alias("w_marks"),
        F.max_by(pair, F.struct("block", "at")).alias("w_last"),
    )
    return lines, ends


def _line_scan(line: Column, delimiter: Column, quote: str, after: bool) -> Column:
    """What a line does to a search for quoted pieces: (n0, open0) if it begins outside a piece, (n1, open1) inside one.

    ``after``: pieces that follow a delimiter, else those that start a line. The numbers are of pieces that end in the line.
    """
    marked = F.contains(line, F.lit(quote))
    if not after:
        whole = line.rlike(f"^{quote}[^{quote}]*{quote}")
        ends = (whole.cast("int"), line.startswith(quote) & ~whole, marked.cast("int"), ~marked)
    else:
        start = F.concat(F.lit("["), delimiter, F.lit(f"]{quote}"))
        run = F.concat(start, F.lit(f"[^{quote}]*{quote}"))
        rest = F.when(marked, F.substring(line, F.instr(line, quote) + 1, F.length(line))).otherwise(F.lit(""))

        def begun(text: Column) -> Column:
            return F.regexp_like(F.regexp_replace(text, run, F.lit("\u0001")), start)

        inside = F.when(marked, F.regexp_count(rest, run) + 1).otherwise(F.lit(0))
        ends = (F.regexp_count(line, run), begun(line), inside, F.when(marked, begun(rest)).otherwise(F.lit(True)))
    return F.struct(*[e.alias(name) for e, name in zip(ends, ("n0", "open0", "n1", "open1"), strict=True)])


def _state_before(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``turned`` and ``fixed``: what the rows in front, within ``keys``, make of the state before the first of them.

    A row leaves the state, turns it or sets it (``sets``). The state before a row is the last one set, else the first one,
    turned as often as rows turned it since: ``fixed`` (null without a set one), else the first state turned by ``turned``.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turned = rows.withColumn("turned", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    kept = F.last(F.when(F.col("sets").isNotNull(), (F.col("sets").cast("int") + F.col("turned")) % 2), ignorenulls=True).over(before)
    return turned.withColumn("fixed", (kept + F.col("turned")) % 2)


def spanning_matches(lines: DataFrame, delimiter: Column) -> DataFrame:
    """(path, doubles, singles): quoted pieces of whole texts, from lines (path, place, line); line ends may lie within pieces.

    Blocks of a file are scanned side by side: a block is one step of a scan over blocks, which tells the state each begins in.
    """
    kinds = [F.struct(F.lit(f"{q}{a}").alias("kind"), _line_scan(F.col("line"), delimiter, q, a).alias("scan")) for q in "\"'" for a in (True, False)]
    steps = lines.select("path", F.col("place.block").alias("block"), "place", F.inline(F.array(*kinds))).select("path", "block", "place", "kind", "scan.*")
    same = F.col("open0") == F.col("open1")
    steps = steps.withColumns({"sets": F.when(same, F.col("open0")), "turns": (F.col("open0") & ~F.col("open1")).cast("int")})
    steps = materialize(_state_before(steps, ["path", "kind", "block"], "place"), "quote-steps")
    # The state behind a block: that before its last line, led through it.
    last = steps.groupBy("path", "kind", "block").agg(F.max_by(F.struct("sets", "turns", "turned", "fixed"), "place").alias("z"))
    turns = (F.col("z.turned") + F.col("z.turns")) % 2
    sets = F.coalesce(F.col("z.sets").cast("int"), (F.col("z.fixed") + F.col("z.turns")) % 2)
    led = last.select("path", "kind", "block", sets.alias("sets"), F.when(sets.isNull(), turns).otherwise(0).alias("turns"))
    blocks = _state_before(led, ["path", "kind"], "block")
    # A file begins outside.
    first = blocks.select("path", "kind", "block", F.coalesce("fixed", "turned").alias("first"))
    found = steps.join(first, ["path", "kind", "block"])
    inside = F.coalesce("fixed", (F.col("first") + F.col("turned")) % 2) == 1
    counted = found.select("path", F.substring("kind", 1, 1).alias("quote"), F.when(inside, F.col("n1")).otherwise(F.col("n0")).alias("n"))
    return counted.groupBy("path").agg(*[F.sum(F.when(F.col("quote") == q, F.col("n")).otherwise(0)).alias(n) for q, n in (('"', "doubles"), ("'", "singles"))])


def line_formats(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Format of each file, found from its lines; columns as ``profiled`` gives them."""
    files = spark.read.format("binaryFile").load(paths)
    files = files.select(F.col("path").alias("listed"), "modificationTime", "length", F.col("_metadata.file_path").alias("path"))
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.lit(0).alias("part")).alias("place"),
        F.col("value").cast("binary").alias("bytes"),
    )
    lines = materialize(raw, "large-lines")
    encodings = materialize(_line_encoding(lines), "large-encodings")
    marks: dict[str, list[str]] = {}
    for r in files.join(encodings.where("byte_order is not null"), "path").select("listed", "byte_order").collect():
        marks.setdefault(r.byte_order, []).append(r.listed)
    wide = F.col("byte_order").isNotNull()
    wide_ends = None
    if marks:
        lines = lines.join(encodings.where(wide), "path", "left_anti")
        for mark, own in sorted(marks.items()):
            more, ends = _wide_lines(spark, own, mark)
            lines, wide_ends = lines.unionByName(more), ends if wide_ends is None else wide_ends.unionByName(ends)
        lines = materialize(lines, "large-all-lines")
    text = F.when(wide, F.col("bytes").cast("string")).otherwise(decode_content(F.col("bytes"), F.col("encoding")))
    decoded = lines.join(encodings, "path").select("path", "place", text.alias("line"), F.octet_length("bytes").alias("size"))
    decoded = decoded.withColumn("filled", ~is_blank(F.col("line")))

    def entry(where: Column | None = None) -> Column:
        made = F.struct("place", "line")
        return made if where is None else F.when(where, made)

    counts = [F.length("line") - F.length(F.replace("line", F.lit(d), F.lit(""))) for d in DELIMITERS]
    measures = []
    for i, count in enumerate(counts):
        own = F.when(F.col("filled"), count)
        measures += [F.max(own).alias(f"high{i}"), F.min(own).alias(f"low{i}"), F.sum(own).alias(f"sum{i}")]
    stats = decoded.groupBy("path").agg(
        F.count("*").alias("lines"), F.count_if("filled").alias("n_filled"), F.sum("size").alias("bytes"),
        F.min(entry()).alias("first"), F.min(entry(F.col("filled"))).alias("shown1"), F.max(entry(F.col("filled"))).alias("last"),
        *measures,
    )

    def even(i: int) -> Column:
        return F.lit(1.0) - (F.col(f"high{i}") - F.col(f"low{i}")) / (F.col(f"high{i}") + 1)

    scores = [F.when(F.col("n_filled") > 0, F.col(f"sum{i}") / F.col("n_filled") * even(i)) for i in range(len(DELIMITERS))]
    stats = stats.withColumn("column_delimiter", pick_delimiter(scores))

    def chosen(values: list[Column]) -> Column:
        result = F.when(F.col("column_delimiter") == DELIMITERS[0], values[0])
        for delimiter, value in zip(DELIMITERS[1:], values[1:], strict=True):
            result = result.when(F.col("column_delimiter") == delimiter, value)
        return result

    indexes = range(len(DELIMITERS))
    stats = stats.withColumns({"evenness": chosen([even(i) for i in indexes]), "cuts": chosen([F.col(f"sum{i}") for i in indexes])})
    stats = materialize(stats.drop(*[f"{m}{i}" for m in ("high", "low", "sum") for i in indexes]), "large-counts")

    delimiter = F.col("column_delimiter")
    judged = decoded.join(stats, "path")
    later = F.col("filled") & (F.col("place") > F.col("shown1.place"))
    open_end = [F.regexp_like("line", F.concat(F.lit("(^|["), delimiter, F.lit(f"]){q}[^{q}]*$"))) for q in "\"'"]
    quotes = judged.groupBy("path").agg(
        F.sum(quote_matches(F.col("line"), delimiter, '"')).alias("doubles"), F.sum(quote_matches(F.col("line"), delimiter, "'")).alias("singles"),
        F.sum(F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))).alias("double_marks"),
        F.sum(F.length("line") - F.length(F.replace("line", F.lit("'"), F.lit("")))).alias("single_marks"),
        F.min(entry(F.col("place") > F.col("first.place"))).alias("second"), F.min(entry(later)).alias("shown2"),
        F.max(entry(F.col("filled") & (F.col("place") < F.col("last.place")))).alias("previous"),
        F.bool_or(open_end[0] | open_end[1]).alias("spans"),
    )
    quotes = materialize(quotes, "large-marks")
    spans = quotes.where("spans").select("path")
    if not spans.isEmpty():
        spanning = spanning_matches(judged.join(spans, "path", "left_semi").select("path", "place", "line", "column_delimiter"), delimiter)
        spanning = spanning.select("path", F.col("doubles").alias("_doubles"), F.col("singles").alias("_singles"))
        quotes = quotes.join(spanning, "path", "left").withColumns({n: F.coalesce(f"_{n}", n) for n in ("doubles", "singles")}).drop("_doubles", "_singles")
    stats = stats.join(quotes.drop("spans"), "path")
    occurs = F.when(F.col("cuts") > 0, delimiter).otherwise(F.lit(""))
    stats = stats.withColumn("text_qualifier", pick_qualifier(occurs, delimiter, F.col("doubles"), F.col("singles")))
    quote = F.col("text_qualifier")
    heads = has_header(parse_fields(F.col("first.line"), delimiter, quote), parse_fields(F.col("second.line"), delimiter, quote))
    stats = materialize(stats.withColumn("has_header", F.when(F.col("second").isNull(), F.lit(True)).otherwise(heads)), "large-quotes")

    judged = decoded.join(stats, "path").where(F.col("filled") & (F.col("place") < F.col("last.place")))
    inner = ~F.col("has_header") | (F.col("place") > F.col("shown1.place"))
    third = F.min(entry(F.col("place") > F.col("shown2.place"))).alias("shown3")
    widths = judged.where(inner).groupBy("path", field_count(F.col("line"), delimiter, quote).alias("width"))
    widths = widths.agg(F.count("*").alias("n"), F.min("place").alias("seen"))
    usual = widths.groupBy("path").agg(F.min_by("width", F.struct(-F.col("n"), F.col("seen"))).alias("typical_width"))
    thirds = decoded.where("filled").join(stats.select("path", "shown2"), "path").groupBy("path").agg(third)
    ends = _line_ends(spark, paths)
    found = files.join(stats.join(usual, "path", "left").join(thirds, "path", "left").join(ends, "path", "left"), "path", "left")
    found = found.join(encodings, "path", "left")
    if wide_ends is None:
        found = found.withColumns(dict.fromkeys(("records", "all_bytes", "w_pairs", "w_marks"), F.lit(None).cast("long")) | {"w_last": F.lit(None).cast("boolean")})
    else:
        found = found.join(wide_ends, "path", "left")

    marks = F.when(quote == '"', F.col("double_marks")).otherwise(F.col("single_marks"))
    balanced = F.when((quote != "") & (marks % 2 == 0), F.lit(CONFIDENCE_QUOTES)).otherwise(F.lit(0.0))
    confidence = F.least(F.lit(CONFIDENCE_BASE) + F.coalesce(F.col("evenness") * CONFIDENCE_EVEN, F.lit(0.0)) + balanced, F.lit(1.0))
    fed, paired = F.coalesce("fed", F.lit(0)), F.coalesce("paired", F.lit(0))
    # The reader drops a byte order mark of UTF-8, so its three bytes are over where bytes and line ends are summed up.
    open_end = (F.col("length") - F.coalesce("fed_bytes", F.lit(0)) - fed).isin(-1, 2)  # no line feed at the end
    pairs = paired - (open_end & F.coalesce("last_paired", F.lit(False))).cast("int")
    feeds = fed - open_end.cast("int") - pairs
    over = F.col("length") - F.col("bytes") - pairs - F.col("lines")
    total = F.col("lines") + over.isin(0, 3).cast("int")  # a line end stands at the end
    returns = total - 1 - pairs - feeds
    # Wide files were cut at line feeds, so all ends are known as counts.
    wide_open = F.col("all_bytes") != F.col("length")
    wide_pairs = F.col("w_pairs") - (wide_open & F.col("w_last")).cast("int")
    wide_feeds = F.col("records") - wide_open.cast("int") - wide_pairs
    wide_returns = F.col("w_marks") - wide_pairs
    pairs, feeds, returns = (F.when(wide, w).otherwise(x) for w, x in ((wide_pairs, pairs), (wide_feeds, feeds), (wide_returns, returns)))
    total = F.when(wide, 1 + pairs + feeds + returns).otherwise(total)
    encoding = F.when((over >= 2) & F.col("encoding").isin(ENCODING_ASCII, ENCODING_UTF8), F.lit(ENCODING_UTF8_BOM)).otherwise(F.col("encoding"))
    row_delimiter = (
        F.when((pairs > 0) & (pairs >= feeds) & (pairs >= returns), F.lit("\r\n"))
        .when((feeds > 0) & (feeds >= returns), F.lit("\n"))
        .when(returns > 0, F.lit("\r"))
        .otherwise(F.lit("\n"))
    )
    last, previous = (field_count(F.col(f"{x}.line"), delimiter, quote) for x in ("last", "previous"))
    regular = F.col("typical_width").isNull() | (previous == F.col("typical_width"))
    trailer = F.coalesce(F.col("previous").isNotNull() & (last != previous) & regular, F.lit(False))
    error = F.when(F.coalesce("n_filled", F.lit(0)) == 0, F.lit(EMPTY_FILE)).when(total < 2, F.lit(ONE_LINE))
    bad = error.isNotNull()
    shown = F.array_compact(F.array(*[F.col(f"shown{i}.line") for i in (1, 2, 3)]))
    sample = F.transform(shown, lambda x: parse_fields(x, delimiter, quote))

    def unless_bad(value: Column, default: object = None) -> Column:
        return F.when(bad, F.lit(default)).otherwise(value)

    return found.select(
        F.col("listed").alias("path"), "modificationTime", "length", F.coalesce(encoding, F.lit(ENCODING_ASCII)).alias("encoding"),
        unless_bad(delimiter, DEFAULT_FORMAT["column_delimiter"]).alias("column_delimiter"),
        unless_bad(row_delimiter, DEFAULT_FORMAT["row_delimiter"]).alias("row_delimiter"),
        unless_bad(quote, DEFAULT_FORMAT["text_qualifier"]).alias("text_qualifier"),
        unless_bad(F.col("has_header"), True).alias("has_header"),
        unless_bad(trailer, False).alias("has_trailer"),
        F.when(~bad & trailer, F.col("last.line")).alias("trailer_line"),
        unless_bad(F.coalesce("typical_width", F.size(F.get(sample, F.lit(0))), F.lit(0))).alias("estimated_columns"),
        F.when(~bad, total.cast("int")).alias("sample_rows"),
        unless_bad(confidence, 0.0).alias("detection_confidence"),
        F.when(~bad, sample).alias("sample_data"),
        unless_bad(delimiter, DEFAULT_FORMAT["column_delimiter"]).alias("header_delimiter"),
        F.lit(0).alias("skip_lines"),
        error.alias("error"),
    )
