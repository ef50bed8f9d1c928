"""Format detection over every text of the given tables, each row taken as one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.functions.cells import ALL_DIGITS, DATE_START, field_count, parse_fields
from refload.functions.detect import (
    HEADER_WORDS,
    decode_content,
    detect_encoding,
    detect_format,
    detect_row_delimiter,
    detection_confidence,
    split_lines,
    with_delimiter,
    with_header,
    with_lines,
    with_qualifier,
    with_trailer,
)
from refload.plans.catalogue import query, table
from refload.plans.queries.names import pick, text
from refload.plans.queries.sqltext import sql_classify, sql_strip

# An order as a small file: delimiter, quoting, line ends, header and trailer vary with the key.
ORDER_FILE_SQL = """
SELECT 'o' || o_orderkey AS file_id,
  CASE WHEN o_orderkey % 3 < 2 THEN concat_ws(d, 'order_id', 'status', 'amount') || eol ELSE '' END
  || concat_ws(d, CAST(o_orderkey AS VARCHAR), q || o_orderstatus || d || 'x' || q, CAST(o_custkey AS VARCHAR)) || eol
  || concat_ws(d, CAST(o_custkey AS VARCHAR), q || o_orderpriority || q, '-' || o_orderkey || '.50') || eol
  || concat_ws(d, strftime(o_orderdate, '%Y-%m-%d'), '', q || 'a' || q || q || 'b' || q) || eol
  || CASE WHEN o_orderkey % 5 = 0 THEN 'TOTAL' || d || o_custkey WHEN o_orderkey % 5 = 1 THEN '  ' || eol ELSE '' END AS content
FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE chr(9) END AS d,
  CASE o_orderkey % 7 WHEN 0 THEN '''' WHEN 1 THEN '' ELSE '"' END AS q,
  CASE o_orderkey % 6 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(13) ELSE chr(10) END AS eol FROM orders)
"""

FILES_SQL = f"""
SELECT 'd' || doc_id AS file_id, text AS content FROM documents
UNION ALL SELECT 'p' || page_id, html FROM pages
UNION ALL SELECT 'c' || conv_id || '_' || turn, text FROM conversations
UNION ALL SELECT 'b' || item_id, text FROM benchmark
UNION ALL {ORDER_FILE_SQL}
"""


def _order_files(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    # Dealt out as rows: a split of the table holds far more files than one of texts, and each takes as long to judge.
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number given is not merged by bytes again
    orders = rows.repartition(partitions, "o_orderkey").withColumns(
        {
            "d": pick(key, F.lit(","), F.lit(";"), F.lit("|"), F.lit("\t")),
            "q": F.when(key % 7 == 0, F.lit("'")).when(key % 7 == 1, F.lit("")).otherwise(F.lit('"')),
            "eol": F.when(key % 6 == 0, F.lit("\r\n")).when(key % 6 == 1, F.lit("\r")).otherwise(F.lit("\n")),
        }
    )
    d, q, eol = F.col("d"), F.col("q"), F.col("eol")

    def line(a: Column, b: Column, c: Column) -> Column:
        return F.concat(a, d, b, d, c, eol)

    header = F.when(key % 3 < 2, line(F.lit("order_id"), F.lit("status"), F.lit("amount"))).otherwise(F.lit(""))
    trailer = F.when(key % 5 == 0, F.concat(F.lit("TOTAL"), d, text("o_custkey"))).when(
        key % 5 == 1, F.concat(F.lit("  "), eol)
    )
    content = F.concat(
        header,
        line(text("o_orderkey"), F.concat(q, "o_orderstatus", d, F.lit("x"), q), text("o_custkey")),
        line(text("o_custkey"), F.concat(q, "o_orderpriority", q), F.concat(F.lit("-"), text("o_orderkey"), F.lit(".50"))),
        line(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(""), F.concat(q, F.lit("a"), q, q, F.lit("b"), q)),
        F.coalesce(trailer, F.lit("")),
    )
    return orders.select(F.concat(F.lit("o"), text("o_orderkey")).alias("file_id"), content.alias("content"))


def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """All texts as files: ``file_id, content``."""

    def named(name: str, key: Column, content: str) -> DataFrame:
        return table(spark, sf, name).select(key.alias("file_id"), F.col(content).alias("content"))

    parts = [
        named("documents", F.concat(F.lit("d"), text("doc_id")), "text"),
        named("pages", F.concat(F.lit("p"), text("page_id")), "html"),
        named("conversations", F.concat(F.lit("c"), text("conv_id"), F.lit("_"), text("turn")), "text"),
        named("benchmark", F.concat(F.lit("b"), text("item_id")), "text"),
    ]
    result = _order_files(spark, sf)
    for part in parts:
        result = result.unionByName(part)
    return result


def _sql_run(q: str) -> str:
    """Pattern of a quoted piece, for a quote given as an SQL expression."""
    return f"{q} || '[^' || {q} || ']*(?:' || {q} || {q} || '[^' || {q} || ']*)*' || {q} || '?'"


def sql_fields(line: str, d: str, q: str) -> str:
    piece = f"'[' || {d} || '](' || {_sql_run(q)} || '[^' || {d} || ']*|[^' || {d} || ']*)'"
    whole = f"'(?s)^' || {q} || '([^' || {q} || ']*(?:' || {q} || {q} || '[^' || {q} || ']*)*)' || {q} || '?(.*)$'"
    unquoted = (
        f"CASE WHEN starts_with(f, {q}) THEN replace(regexp_extract(f, {whole}, 1), {q} || {q}, {q}) || "
        f"regexp_extract(f, {whole}, 2) ELSE f END"
    )
    return (
        f"CASE WHEN {line} = '' THEN CAST([] AS VARCHAR[]) WHEN {q} = '' THEN string_split({line}, {d}) "
        f"ELSE list_transform(regexp_extract_all({d} || {line}, {piece}, 1), lambda f: {unquoted}) END"
    )


def sql_width(line: str, d: str, q: str) -> str:
    opened = f"'(^|[' || {d} || '])' || {_sql_run(q)}"
    bare = f"CASE WHEN {q} = '' THEN {line} ELSE regexp_replace({line}, {opened}, '\\1', 'g') END"
    return f"CASE WHEN {line} = '' THEN 0 ELSE 1 + length({bare}) - length(replace({bare}, {d}, '')) END"


def _sql_score(i: int) -> str:
    return (
        f"CASE WHEN len(c{i}) > 0 THEN list_sum(c{i}) / len(c{i}) * "
        f"(CAST(1 AS DOUBLE) - (list_max(c{i}) - list_min(c{i})) / (list_max(c{i}) + 1)) END AS s{i}"
    )


_DELIMITERS = ["','", "';'", "'|'", "chr(9)"]
_PIECES = "'[' || d || ']' || '{0}[^{0}]*{0}'"
DETECT_SQL = (
    f"WITH files AS ({FILES_SQL}), "
    "lined AS (SELECT *, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM files), "
    f"headed AS (SELECT *, list_filter(lines, lambda x: {sql_strip('x')} <> '') AS filled, "
    f"list_filter(lines, lambda x: {sql_strip('x')} <> '') AS head FROM lined), "
    "counted AS (SELECT *, "
    + ", ".join(
        f"list_transform(head, lambda x: length(x) - length(replace(x, {d}, ''))) AS c{i}" for i, d in enumerate(_DELIMITERS)
    )
    + " FROM headed), "
    + "scored AS (SELECT *, " + ", ".join(_sql_score(i) for i in range(4)) + " FROM counted), "
    + "best AS (SELECT *, greatest(s0, s1, s2, s3) AS top FROM scored), "
    + "delimited AS (SELECT *, CASE WHEN top IS NULL OR s0 = top THEN ',' WHEN s1 = top THEN ';' WHEN s2 = top THEN '|' ELSE chr(9) END AS d, "
    + "CASE WHEN top IS NULL OR s0 = top THEN c0 WHEN s1 = top THEN c1 WHEN s2 = top THEN c2 ELSE c3 END AS counts FROM best), "
    + "quoted AS (SELECT *, "
    + f"len(regexp_extract_all(content, {_PIECES.format(chr(34))})) + len(regexp_extract_all(content, '(?m)^\"[^\"]*\"')) AS doubles, "
    + "len(regexp_extract_all(content, '[' || d || ']' || '''[^'']*''')) + len(regexp_extract_all(content, '(?m)^''[^'']*''')) AS singles FROM delimited), "
    + "qualified AS (SELECT *, CASE WHEN doubles > singles THEN '\"' WHEN singles > 0 THEN '''' "
    + "WHEN contains(content, d) THEN '\"' ELSE '' END AS q FROM quoted), "
    + f"rowed AS (SELECT *, {sql_fields('lines[1]', 'd', 'q')} AS first_row, "
    + f"CASE WHEN len(lines) > 1 THEN {sql_fields('lines[2]', 'd', 'q')} END AS second_row FROM qualified), "
    + "judged AS (SELECT *, len(lines) < 2 OR len(first_row) <> len(second_row) OR "
    + f"(len(list_filter(first_row, lambda c: {sql_classify('c', ALL_DIGITS, DATE_START)} <> 'string')) = 0 AND "
    + f"len(list_filter(second_row, lambda c: {sql_classify('c', ALL_DIGITS, DATE_START)} = 'number')) > 0) OR "
    + f"len(list_filter(first_row, lambda c: regexp_matches(lower(c), '{'|'.join(HEADER_WORDS)}'))) > len(first_row) * CAST(0.3 AS DOUBLE) AS has_header FROM rowed), "
    + f"measured AS (SELECT *, list_transform(filled[(1 + CAST(has_header AS INTEGER)):len(filled) - 1], lambda x: {sql_width('x', 'd', 'q')}) AS widths, "
    + f"{sql_width('filled[len(filled)]', 'd', 'q')} AS last_width, "
    + f"CASE WHEN len(filled) > 1 THEN {sql_width('filled[len(filled) - 1]', 'd', 'q')} END AS prev_width FROM judged), "
    + "usual AS (SELECT *, list_max(list_transform(range(1, len(widths) + 1), lambda i: "
    + "{'n': len(list_filter(widths, lambda x: x = widths[i])), 'i': -i, 'w': widths[i]})).w AS typical FROM measured), "
    + "trailed AS (SELECT *, coalesce(len(filled) > 1 AND last_width <> prev_width AND (typical IS NULL OR prev_width = typical), false) AS has_trailer FROM usual), "
    + "ended AS (SELECT *, CASE WHEN has_trailer THEN filled[len(filled)] END AS trailer_line, "
    + "length(content) - length(replace(content, chr(13) || chr(10), '')) AS crlf2, "
    + "length(content) - length(replace(content, chr(10), '')) AS lfs, length(content) - length(replace(content, chr(13), '')) AS crs FROM trailed), "
    + "final AS (SELECT *, CASE WHEN crlf2 > 0 AND crlf2 / 2 >= lfs - crlf2 / 2 AND crlf2 / 2 >= crs - crlf2 / 2 THEN chr(13) || chr(10) "
    + "WHEN lfs - crlf2 / 2 > 0 AND lfs >= crs THEN chr(10) WHEN crs - crlf2 / 2 > 0 THEN chr(13) ELSE chr(10) END AS row_delimiter, "
    + "round(least(CAST(0.5 AS DOUBLE) + CASE WHEN len(counts) > 0 THEN (CAST(1 AS DOUBLE) - (list_max(counts) - list_min(counts)) / (list_max(counts) + 1)) * CAST(0.3 AS DOUBLE) ELSE 0 END "
    + "+ CASE WHEN q <> '' AND (length(content) - length(replace(content, q, ''))) % 2 = 0 THEN CAST(0.2 AS DOUBLE) ELSE 0 END, 1), 6) AS confidence, "
    + f"CASE WHEN {sql_strip('content')} = '' THEN 'File appears to be empty' WHEN len(lines) < 2 THEN 'File must have at least 2 lines for detection' END AS error, "
    + f"CASE WHEN len(head) > 0 THEN {sql_fields('head[1]', 'd', 'q')} END AS sample FROM ended) "
)


def up_to(files: DataFrame, step: str) -> DataFrame:
    """Detection steps in order, until the named one."""
    steps = {
        "lines": lambda df: with_lines(df, "content"),
        "delimiter": with_delimiter,
        "qualifier": lambda df: with_qualifier(df, "content"),
        "header": with_header,
        "trailer": with_trailer,
    }
    for name, add in steps.items():
        files = add(files)
        if name == step:
            return files
    raise ValueError(step)


@query("detect_delimiter", DETECT_SQL + "SELECT file_id, d AS column_delimiter, round(top, 6) AS score FROM final")
def detect_delimiter_query(spark: SparkSession, sf: str) -> DataFrame:
    found = up_to(text_files(spark, sf), "delimiter")
    top = F.greatest("score_0", "score_1", "score_2", "score_3")
    return found.select("file_id", "column_delimiter", F.round(top, 6).alias("score"))


@query("detect_row_delimiter", DETECT_SQL + "SELECT file_id, row_delimiter FROM final")
def detect_row_delimiter_query(spark: SparkSession, sf: str) -> DataFrame:
    files = text_files(spark, sf)
    return files.select("file_id", detect_row_delimiter(F.col("content")).alias("row_delimiter"))


@query("detect_qualifier", DETECT_SQL + "SELECT file_id, q AS text_qualifier FROM final")
def detect_qualifier_query(spark: SparkSession, sf: str) -> DataFrame:
    return up_to(text_files(spark, sf), "qualifier").select("file_id", "text_qualifier")


@query("detect_header", DETECT_SQL + "SELECT file_id, has_header FROM final")
def detect_header_query(spark: SparkSession, sf: str) -> DataFrame:
    return up_to(text_files(spark, sf), "header").select("file_id", "has_header")


@query("detect_trailer", DETECT_SQL + "SELECT file_id, has_trailer, trailer_line FROM final")
def detect_trailer_query(spark: SparkSession, sf: str) -> DataFrame:
    return up_to(text_files(spark, sf), "trailer").select("file_id", "has_trailer", "trailer_line")


@query("trailer_typical_width", DETECT_SQL + "SELECT file_id, CAST(typical AS VARCHAR) AS typical_width FROM final")
def trailer_typical_width_query(spark: SparkSession, sf: str) -> DataFrame:
    return up_to(text_files(spark, sf), "trailer").select(
        "file_id", F.col("typical_width").cast("string").alias("typical_width")
    )


@query("detection_confidence", DETECT_SQL + "SELECT file_id, confidence FROM final")
def detection_confidence_query(spark: SparkSession, sf: str) -> DataFrame:
    found = up_to(text_files(spark, sf), "qualifier")
    score = detection_confidence(F.col("content"), F.col("evenness"), F.col("text_qualifier"))
    return found.select("file_id", F.round(score, 6).alias("confidence"))


@query(
    "detect_format",
    DETECT_SQL
    + "SELECT file_id, CASE WHEN error IS NULL THEN d ELSE ',' END AS column_delimiter, "
    "CASE WHEN error IS NULL THEN row_delimiter ELSE chr(10) END AS row_delimiter, "
    "CASE WHEN error IS NULL THEN q ELSE '\"' END AS text_qualifier, "
    "CASE WHEN error IS NULL THEN has_header ELSE true END AS has_header, "
    "CASE WHEN error IS NULL THEN has_trailer ELSE false END AS has_trailer, "
    "CASE WHEN error IS NULL THEN trailer_line END AS trailer_line, "
    "CASE WHEN error IS NULL THEN CAST(coalesce(typical, len(sample), 0) AS VARCHAR) END AS estimated_columns, "
    "CASE WHEN error IS NULL THEN CAST(len(lines) AS VARCHAR) END AS sample_rows, "
    "CASE WHEN error IS NULL THEN confidence ELSE 0 END AS confidence, error FROM final",
)
def detect_format_query(spark: SparkSession, sf: str) -> DataFrame:
    return detect_format(text_files(spark, sf), "content").select(
        "file_id",
        "column_delimiter",
        "row_delimiter",
        "text_qualifier",
        "has_header",
        "has_trailer",
        "trailer_line",
        F.col("estimated_columns").cast("string").alias("estimated_columns"),
        F.col("sample_rows").cast("string").alias("sample_rows"),
        F.round("detection_confidence", 6).alias("confidence"),
        "error",
    )


@query(
    "parse_fields",
    f"""WITH files AS ({FILES_SQL}),
    lined AS (SELECT file_id, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM files),
    numbered AS (SELECT file_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_number FROM lined),
    parsed AS (SELECT file_id, line_number, {sql_fields("line", "','", "chr(34)")} AS fields, {sql_width("line", "','", "chr(34)")} AS width FROM numbered)
    SELECT file_id, CAST(line_number AS INTEGER) AS line_number, CAST(width AS INTEGER) AS width,
      array_to_string(fields, '¦') AS fields FROM parsed""",
)
def parse_fields_query(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every text, cut at commas outside double quotes."""
    lines = text_files(spark, sf).select("file_id", F.posexplode(split_lines(F.col("content"))).alias("pos", "line"))
    comma, quote = F.lit(","), F.lit('"')
    return lines.select(
        "file_id",
        (F.col("pos") + 1).alias("line_number"),
        field_count(F.col("line"), comma, quote).alias("width"),
        F.array_join(parse_fields(F.col("line"), comma, quote), "¦").alias("fields"),
    )


@query(
    "detect_encoding",
    r"""WITH texts AS (SELECT doc_id, text, CASE WHEN doc_id % 5 > 2 AND regexp_matches(text, '[^\x{00}-\x{7f}\x{a0}-\x{ff}]') THEN 0 ELSE doc_id % 5 END AS kind FROM documents)
    SELECT doc_id, CASE WHEN kind = 1 THEN 'UTF-16' WHEN kind = 2 THEN 'UTF-8-SIG' WHEN kind = 3 THEN 'Windows-1252'
        WHEN NOT regexp_matches(text, '[^\x{00}-\x{7f}]') THEN 'ascii' WHEN kind = 0 THEN 'utf-8' ELSE 'ISO-8859-1' END AS encoding,
      CASE WHEN kind = 3 THEN text || ' ‘100 €’ – …' ELSE text END AS text
    FROM texts""",
)
def detect_encoding_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each text in one of five encodings, recognised and decoded again; a text that a byte encoding cannot hold is UTF-8."""
    wide = F.col("text").rlike(r"[^\x{00}-\x{7f}\x{a0}-\x{ff}]")
    kind = F.when((F.col("doc_id") % 5 > 2) & wide, F.lit(0)).otherwise(F.col("doc_id") % 5)
    content = (
        F.when(kind == 0, F.encode("text", "UTF-8"))
        .when(kind == 1, F.encode("text", "UTF-16"))
        .when(kind == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(kind == 3, F.concat(F.encode("text", "ISO-8859-1"), F.unhex(F.lit("209131303020809220962085"))))
        .otherwise(F.encode("text", "ISO-8859-1"))
    )
    files = table(spark, sf, "documents").select("doc_id", content.alias("content"))
    named = files.withColumn("encoding", detect_encoding(F.col("content")))
    return named.select("doc_id", "encoding", decode_content(F.col("content"), F.col("encoding")).alias("text"))
