"""Column relations, widths, and tables whose schema changes."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.functions.types import canonical_type
from refload.operators.evolve import (
    backup_rotate,
    column_set_ops,
    ensure_metadata_columns,
    infer_widths,
    schema_diff,
    sync_backup_schema,
    sync_columns_add_only,
    sync_columns_widen,
)
from refload.operators.registry import REGISTRY_COLUMNS, match_one, match_owners, match_schema, place_candidates, upsert_registry
from refload.operators.tables import VERSION, create_table
from refload.operators.versions import create_backup, snapshot_version
from refload.plans.catalogue import query, table
from refload.plans.queries.scans import new_warehouse
from refload.sources.descriptors import parse_descriptor, persist_inferred_schema, write_format_descriptor

AT = datetime(2024, 1, 31, 12, 0)
ALL_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

WIDTH_COLUMNS = {
    "customer": ["c_name", "c_mktsegment"],
    "part": ["p_name", "p_brand", "p_type"],
    "documents": ["text", "lang", "source"],
    "pages": ["url", "html"],
    "conversations": ["role", "text"],
}


def sql_bucket(longest: str) -> str:
    return (
        f"CASE WHEN {longest} IS NULL OR {longest} = 0 THEN 'varchar(1024)' WHEN {longest} <= 500 THEN 'varchar(1024)' "
        f"WHEN {longest} <= 1000 THEN 'varchar(4000)' WHEN {longest} <= 4000 THEN 'varchar(8000)' ELSE 'varchar(MAX)' END"
    )


@query(
    "infer_widths",
    "SELECT table_name, column_name, CAST(longest AS INTEGER) AS longest, "
    + sql_bucket("longest")
    + " AS data_type FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, max(length({c})) AS longest FROM {t}"
        for t, columns in WIDTH_COLUMNS.items()
        for c in columns
    )
    + ")",
)
def infer_widths_query(spark: SparkSession, sf: str) -> DataFrame:
    parts = [infer_widths(table(spark, sf, t), c).withColumn("table_name", F.lit(t)) for t, c in WIDTH_COLUMNS.items()]
    return reduce(DataFrame.unionByName, parts).select("table_name", "column_name", "longest", "data_type")


@query(
    "persist_inferred_schema",
    """WITH widths AS (SELECT source, 'lang' AS column_name, max(length(lang)) AS longest FROM documents GROUP BY source
      UNION ALL SELECT source, 'text', max(length(text)) FROM documents GROUP BY source)
    SELECT source, source || '.csv' AS filename, column_name, """
    + sql_bucket("longest")
    + " AS data_type FROM widths",
)
def persist_inferred_schema_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each source of documents as a file: its column types go into its descriptor."""
    docs = table(spark, sf, "documents")
    widths = infer_widths(docs, ["text", "lang"], ["source"])
    none = F.lit(None).cast("string")
    document = write_format_descriptor(
        F.concat("source", F.lit(".csv")), F.lit("2024-01-31T12:00:00"), F.lit(","), F.lit(","), F.lit("\\n"), F.lit('"'),
        F.lit(0), none, F.lit("utf-8"),
    )
    descriptors = docs.select("source").distinct().withColumn("document", document)
    merged = persist_inferred_schema(descriptors, widths, "source", "document")
    parsed = merged.withColumn("d", parse_descriptor(F.col("document")))
    return parsed.select(
        "source", F.col("d.file_info.original_filename").alias("filename"), F.explode("d.inferred_schema").alias("column_name", "data_type")
    )


DESCRIBE_SQL = f"""
SELECT table_name, column_name AS name, CAST(ordinal_position AS INTEGER) AS position,
  CASE data_type WHEN 'VARCHAR' THEN 'varchar' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'TIMESTAMP' THEN 'datetime' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END AS data_type
FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in ALL_TABLES)})
"""


@query(
    "schema_diff",
    """WITH expected AS (SELECT p_brand, lower(p_name) AS name, 'varchar(' || max(p_size) || ')' AS type FROM part WHERE p_size < 40 GROUP BY ALL),
    existing AS (SELECT p_brand, lower(p_name) AS name, 'varchar(' || max(p_size) || ')' AS type FROM part WHERE p_size > 10 GROUP BY ALL)
    SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce(a.name, b.name) AS name, a.type AS expected_type, b.type AS existing_type,
      CASE WHEN b.type IS NULL THEN 'added' WHEN a.type IS NULL THEN 'extra' WHEN a.type = b.type THEN 'skipped' ELSE 'mismatched' END AS verdict
    FROM expected a FULL JOIN existing b ON a.p_brand = b.p_brand AND a.name = b.name""",
)
def schema_diff_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand as a table, its part names as columns, their sizes as declared widths."""
    expected, existing = _brand_columns(spark, sf)
    return schema_diff(expected, existing, ["p_brand"])


def _brand_columns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part")
    none = F.lit(None).cast("int")

    def columns(rows: DataFrame) -> DataFrame:
        widest = rows.groupBy("p_brand", F.col("p_name").alias("name")).agg(F.max("p_size").alias("w"))
        return widest.select("p_brand", "name", canonical_type(F.lit("varchar"), F.col("w"), none, none).alias("type"))

    return columns(part.where("p_size < 40")), columns(part.where("p_size > 10"))


@query(
    "column_set_ops",
    """WITH expected AS (SELECT p_brand, p_name AS name, 'varchar(' || max(p_size) || ')' AS type FROM part WHERE p_size < 40 GROUP BY ALL),
    existing AS (SELECT p_brand, p_name AS name, 'varchar(' || max(p_size) || ')' AS type FROM part WHERE p_size > 10 GROUP BY ALL)
    SELECT *, 'missing' AS side FROM (SELECT * FROM expected EXCEPT ALL SELECT * FROM existing)
    UNION ALL SELECT *, 'extra' FROM (SELECT * FROM existing EXCEPT ALL SELECT * FROM expected)""",
)
def column_set_ops_query(spark: SparkSession, sf: str) -> DataFrame:
    expected, existing = _brand_columns(spark, sf)
    return column_set_ops(expected, existing, ["p_brand", "name", "type"])


SIGNATURE_SQL = """
WITH files AS (SELECT DISTINCT user_id * 100 + day(ts) AS owner, lower(event_type || hour(ts) % 4) AS n FROM events),
tables AS (SELECT DISTINCT dayofyear(ts) * 100 + hour(ts) AS owner, lower(event_type || user_id % 4) AS n FROM events),
file_sets AS (SELECT names, count(*) AS file_owners, min(owner) AS file_example FROM
  (SELECT owner, list_sort(list(n)) AS names FROM files GROUP BY owner) GROUP BY names),
table_sets AS (SELECT names, count(*) AS table_owners, min(owner) AS table_example FROM
  (SELECT owner, list_sort(list(n)) AS names FROM tables GROUP BY owner) GROUP BY names),
pairs AS (SELECT *, len(list_intersect(f.names, t.names)) AS shared, len(f.names) + len(t.names) - len(list_intersect(f.names, t.names)) AS total
  FROM file_sets f, table_sets t),
matches AS (SELECT file_example, file_owners, table_example, table_owners, CAST(shared AS INTEGER) AS matching_columns,
  CAST(total AS INTEGER) AS total_columns, round(shared / total, 6) AS match_percentage FROM pairs WHERE shared / total > 0.7)
"""


def _event_columns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf, "events")

    def kind(extra: F.Column) -> F.Column:
        return F.concat("event_type", (extra % 4).cast("string")).alias("n")

    files = events.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("file"), kind(F.hour("ts")))
    tables = events.select((F.dayofyear("ts") * 100 + F.hour("ts")).cast("long").alias("table"), kind(F.col("user_id")))
    return files, tables


def _event_matches(spark: SparkSession, sf: str) -> DataFrame:
    files, tables = _event_columns(spark, sf)
    return match_schema(files, tables, "file", "table", "n").select(
        "file_example",
        "file_owners",
        "table_example",
        "table_owners",
        "matching_columns",
        "total_columns",
        F.round("match_percentage", 6).alias("match_percentage"),
    )


@query("match_schema", SIGNATURE_SQL + "SELECT * FROM matches")
def match_schema_query(spark: SparkSession, sf: str) -> DataFrame:
    """What a user did on a day as a header, what was done in an hour as a table."""
    return _event_matches(spark, sf)


@query(
    "match_owners",
    SIGNATURE_SQL
    + """SELECT m.file_example, o.owner AS "table", m.match_percentage FROM (SELECT *, round(shared / total, 6) AS match_percentage
      FROM (SELECT f.file_example, t.names AS table_names, len(list_intersect(f.names, t.names)) AS shared,
        len(f.names) + len(t.names) - len(list_intersect(f.names, t.names)) AS total FROM file_sets f, table_sets t) WHERE shared / total > 0.7) m
      JOIN (SELECT owner, list_sort(list(n)) AS names FROM tables GROUP BY owner) o ON o.names = m.table_names""",
)
def match_owners_query(spark: SparkSession, sf: str) -> DataFrame:
    """Every table that fits each distinct header."""
    files, tables = _event_columns(spark, sf)
    found = match_owners(match_schema(files, tables, "file", "table", "n"), tables, "table", "n")
    return found.select("file_example", "table", F.round("match_percentage", 6).alias("match_percentage"))


@query(
    "rank_candidates",
    SIGNATURE_SQL
    + "SELECT *, row_number() OVER (ORDER BY match_percentage DESC, file_example, table_example) AS place FROM matches",
)
def rank_candidates_query(spark: SparkSession, sf: str) -> DataFrame:
    """All matches with their place, the best first."""
    return place_candidates(_event_matches(spark, sf), "match_percentage", ["file_example", "table_example"])


@query(
    "match_one_header",
    """WITH sets AS (SELECT p_brand, count(DISTINCT p_name) AS own, count(DISTINCT p_name) FILTER (WHERE p_name NOT LIKE 'red%') AS shared,
      (SELECT count(DISTINCT p_name) FROM part WHERE p_name NOT LIKE 'red%') AS wanted FROM part GROUP BY p_brand)
    SELECT p_brand, shared AS matching_columns, own + wanted - shared AS total_columns,
      round(shared / (own + wanted - shared), 6) AS match_percentage FROM sets WHERE shared / (own + wanted - shared) > 0.7""",
)
def match_one_header_query(spark: SparkSession, sf: str) -> DataFrame:
    """One header (all part names but the red ones) against the part names of each brand."""
    part = table(spark, sf, "part")
    found = match_one(part.where(~F.col("p_name").startswith("red")), part, "p_brand", "p_name")
    return found.withColumn("match_percentage", F.round("match_percentage", 6))


@query(
    "upsert_registry",
    """WITH old AS (SELECT 'ref_' || s_name AS ref_name, 'usp_' || s_nationkey AS sp_name, 'db' AS source_db, 'ref' AS source_schema,
        s_name AS source_table, 1 AS is_enabled FROM supplier WHERE s_suppkey % 4 <> 0),
    new AS (SELECT 'ref_' || s_name AS ref_name, 'usp_' || CASE WHEN s_acctbal > 5000 THEN s_nationkey + 1 ELSE s_nationkey END AS sp_name,
        'db' AS source_db, 'ref' AS source_schema, s_name AS source_table, 1 AS is_enabled FROM supplier WHERE s_suppkey % 4 <> 1)
    SELECT coalesce(n.ref_name, o.ref_name) AS ref_name, coalesce(n.sp_name, o.sp_name) AS sp_name,
      coalesce(n.source_table, o.source_table) AS source_table,
      CASE WHEN n.ref_name IS NULL THEN 'kept' WHEN o.ref_name IS NULL THEN 'insert' WHEN o.sp_name = n.sp_name THEN 'unchanged' ELSE 'update' END AS action
    FROM old o FULL JOIN new n ON o.ref_name = n.ref_name""",
)
def upsert_registry_query(spark: SparkSession, sf: str) -> DataFrame:
    supplier = table(spark, sf, "supplier")

    def entries(rows: DataFrame, nation: F.Column) -> DataFrame:
        return rows.select(
            F.concat(F.lit("ref_"), "s_name").alias("ref_name"),
            F.concat(F.lit("usp_"), nation.cast("string")).alias("sp_name"),
            F.lit("db").alias("source_db"),
            F.lit("ref").alias("source_schema"),
            F.col("s_name").alias("source_table"),
            F.lit(1).alias("is_enabled"),
        )

    nation = F.col("s_nationkey")
    old = entries(supplier.where("s_suppkey % 4 <> 0"), nation)
    new = entries(supplier.where("s_suppkey % 4 <> 1"), F.when(F.col("s_acctbal") > 5000, nation + 1).otherwise(nation))
    return upsert_registry(old, new, "ref_name", REGISTRY_COLUMNS).select("ref_name", "sp_name", "source_table", "action")


@query(
    "ensure_metadata_columns",
    """SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS ref_data_loadtype, true AS time_is_null,
      'ref_data_loadtime,ref_data_loadtype' AS added FROM customer""",
)
def ensure_metadata_columns_query(spark: SparkSession, sf: str) -> DataFrame:
    wh = new_warehouse(spark, "metadata")
    name = wh.main("customer")
    create_table(wh, name, table(spark, sf, "customer").select("c_custkey", "c_name"))
    added = ensure_metadata_columns(wh, name)
    rows = wh.table(name)
    return rows.select(
        "c_custkey", "c_name", "ref_data_loadtype", F.col("ref_data_loadtime").isNull().alias("time_is_null"),
        F.lit(",".join(added)).alias("added"),
    )


def _names_table(spark: SparkSession, sf: str, label: str):
    wh = new_warehouse(spark, label)
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    create_table(wh, wh.main("customer"), rows, {"c_name": "varchar(1024)", "c_mktsegment": "varchar(1024)"})
    return wh


@query(
    "sync_columns_add_only",
    """SELECT c_custkey, c_name, c_mktsegment, CAST(NULL AS VARCHAR) AS region,
      'added: region; extra: c_mktsegment; mismatched: c_custkey; skipped: c_name' AS report FROM customer""",
)
def sync_columns_add_only_query(spark: SparkSession, sf: str) -> DataFrame:
    wh = _names_table(spark, sf, "addonly")
    name = wh.main("customer")
    report = sync_columns_add_only(wh, name, {"C_CUSTKEY": "varchar(1024)", "c_name": "varchar(1024)", "region": "varchar(4000)"})
    text = "; ".join(f"{k}: {','.join(v)}" for k, v in sorted(report.items()))
    return wh.table(name).withColumn("report", F.lit(text))


@query(
    "sync_columns_widen",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, CAST(NULL AS VARCHAR) AS region,
      'added: region; skipped: c_mktsegment; widened: c_custkey,c_name' AS report,
      'varchar(1024),varchar(8000),varchar(1024),varchar(4000)' AS declared FROM customer""",
)
def sync_columns_widen_query(spark: SparkSession, sf: str) -> DataFrame:
    wh = _names_table(spark, sf, "widen")
    name = wh.main("customer")
    wanted = {"c_custkey": "varchar(1024)", "c_name": "varchar(8000)", "c_mktsegment": "varchar(500)", "region": "varchar(4000)"}
    report = sync_columns_widen(wh, name, wanted)
    text = "; ".join(f"{k}: {','.join(v)}" for k, v in sorted(report.items()))
    rows = wh.table(name)
    declared = ",".join(f.metadata.get("comment", "") for f in rows.schema.fields)
    return rows.withColumns({"report": F.lit(text), "declared": F.lit(declared)})


@query(
    "sync_backup_schema",
    """SELECT c_custkey, c_name, CASE WHEN v.version = 2 THEN c_mktsegment END AS c_mktsegment, v.version AS version,
      'True added=c_mktsegment modified=c_name' AS report, 'False Incompatible type change for column c_custkey: bigint -> varchar(10)' AS refused
    FROM customer, (VALUES (1), (2)) v(version)""",
)
def sync_backup_schema_query(spark: SparkSession, sf: str) -> DataFrame:
    wh = new_warehouse(spark, "backupsync")
    main = wh.main("customer")
    customers = table(spark, sf, "customer")
    create_table(wh, main, customers.select("c_custkey", "c_name"), {"c_name": "varchar(1024)"})
    snapshot_version(wh, "customer", AT)
    create_table(wh, main, customers.select("c_custkey", "c_name", "c_mktsegment"), {"c_name": "varchar(8000)", "c_mktsegment": "varchar(1024)"})
    done = sync_backup_schema(wh, "customer", {"c_custkey": "bigint", "c_name": "varchar(8000)", "c_mktsegment": "varchar(1024)"})
    refused = sync_backup_schema(wh, "customer", {"c_custkey": "varchar(10)", "c_name": "varchar(8000)"})
    snapshot_version(wh, "customer", AT)
    report = f"{done['success']} added={','.join(done['added'])} modified={','.join(done['modified'])}"
    return wh.table(wh.backup("customer")).select(
        "c_custkey", "c_name", "c_mktsegment", F.col(VERSION).alias("version"), F.lit(report).alias("report"),
        F.lit(f"{refused['success']} {refused['errors'][0]}").alias("refused"),
    )


@query(
    "backup_rotate",
    """SELECT 'customer_backup_20240131120000' AS table_name, count(*) AS row_count FROM customer
      UNION ALL SELECT 'customer_backup', count(*) FROM customer WHERE c_custkey % 2 = 0""",
)
def backup_rotate_query(spark: SparkSession, sf: str) -> DataFrame:
    wh = new_warehouse(spark, "rotate")
    main = wh.main("customer")
    customers = table(spark, sf, "customer")
    create_table(wh, main, customers)
    create_backup(wh, "customer", wh.table(main))
    snapshot_version(wh, "customer", AT)
    create_table(wh, main, customers.where("c_custkey % 2 = 0").withColumn("c_custkey", F.col("c_custkey").cast("string")))
    old = backup_rotate(wh, "customer", AT)
    snapshot_version(wh, "customer", AT)
    names = {old: f"{wh.backup_schema}.{old}", "customer_backup": wh.backup("customer")}
    parts = [wh.table(n).agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(k)) for k, n in names.items()]
    return parts[0].unionByName(parts[1])
