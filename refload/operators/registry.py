"""The load registry and the search for tables whose columns fit a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refload.session import materialize

# Fixed value: a table fits where more than this share of all names is common to both.
MATCH_SHARE = 0.7
# How registry entries are named.
REFRESH_PREFIX, REF_PREFIX, ENABLED = "usp_RefreshReferenceData_", "ref_", 1
REGISTRY_COLUMNS = ["sp_name", "source_db", "source_schema", "source_table", "is_enabled"]


def registry_row(database: Column, schema: Column, table: Column) -> list[Column]:
    """Columns of the registry entry of a table."""
    return [
        F.concat(F.lit(REFRESH_PREFIX), database).alias("sp_name"),
        F.concat(F.lit(REF_PREFIX), table).alias("ref_name"),
        database.alias("source_db"),
        schema.alias("source_schema"),
        table.alias("source_table"),
        F.lit(ENABLED).alias("is_enabled"),
    ]


def upsert_registry(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Registry after taking in entries, with what was done: insert, update, unchanged or kept.

    The key is unique on both sides, so the outer join pairs single rows.
    """
    old = current.select(key, F.struct(*columns).alias("_old"))
    new = incoming.select(key, F.struct(*columns).alias("_new"))
    action = (
        F.when(F.col("_new").isNull(), F.lit("kept"))
        .when(F.col("_old").isNull(), F.lit("insert"))
        .when(F.col("_old").eqNullSafe(F.col("_new")), F.lit("unchanged"))
        .otherwise(F.lit("update"))
    )
    merged = old.join(new, key, "full_outer").withColumn("action", action)
    chosen = F.coalesce("_new", "_old")
    return merged.select(key, *[chosen[c].alias(c) for c in columns], "action")


def column_sets(columns: DataFrame, owner: str, name: str) -> DataFrame:
    """(set_id, owner, names): the set of column names of each owner, under an id that equal sets share.

    A set is as large as one header. Names are made distinct before they are gathered.
    """
    names = columns.select(F.col(owner).alias("owner"), F.lower(name).alias("n")).distinct()
    sets = names.groupBy("owner").agg(F.array_sort(F.collect_list("n")).alias("names"))
    return sets.select(F.sha1(F.array_join("names", "\u001f").cast("binary")).alias("set_id"), "owner", "names")


def _distinct_sets(members: DataFrame, tag: str) -> DataFrame:
    """Each set once, with the number of its owners and the first of them; equal sets are compared once."""
    owners = F.count("*").alias(f"{tag}_owners"), F.min("owner").alias(f"{tag}_example")
    return members.groupBy("set_id").agg(F.first("names").alias("names"), *owners)


def _prefix(names: Column, share: float) -> Column:
    """The rarest names of a set, enough that two sets over the share must have one of them in common."""
    needed = F.ceil(F.size(names) * F.lit(share))
    return F.slice(names, 1, (F.size(names) - needed + 1).cast("int"))


def match_schema(
    files: DataFrame, tables: DataFrame, file: str, table: str, name: str, share: float = MATCH_SHARE
) -> DataFrame:
    """Column sets of files and of tables that overlap by more than ``share`` (common over all names).

    Works on distinct sets, named by id, so any number of equal headers is one comparison; ``column_sets`` tells all
    owners of an id. Candidates come from an equi-join on the rarest names of each set: two sets over the share
    cannot miss each other there, while names that nearly every table has are not joined on. Each candidate is
    then measured exactly. The sets are stored once, since every step reads them.
    """
    left = materialize(_distinct_sets(column_sets(files, file, name), "file"), "file-sets")
    right = materialize(_distinct_sets(column_sets(tables, table, name), "table"), "table-sets")
    counts = (
        left.select(F.explode("names").alias("n"))
        .unionByName(right.select(F.explode("names").alias("n")))
        .groupBy("n")
        .agg(F.count("*").alias("uses"))
    )

    def rare_first(sets: DataFrame, tag: str) -> DataFrame:
        ranked = (
            sets.select("set_id", F.explode("names").alias("n"))
            .join(counts, "n")
            .groupBy("set_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("uses", "n"))), lambda x: x["n"]).alias("rare"))
        )
        return ranked.select(
            F.col("set_id").alias(f"{tag}_set"), F.size("rare").alias(f"{tag}_size"), F.explode(_prefix(F.col("rare"), share)).alias("token")
        )

    candidates = (
        rare_first(left, "file")
        .join(rare_first(right, "table"), "token")
        .where((F.col("file_size") > F.col("table_size") * share) & (F.col("table_size") > F.col("file_size") * share))
        .select("file_set", "table_set")
        .distinct()
    )
    pairs = candidates.join(left.withColumnsRenamed({"set_id": "file_set", "names": "file_names"}), "file_set").join(
        right.withColumnsRenamed({"set_id": "table_set", "names": "table_names"}), "table_set"
    )
    shared = F.size(F.array_intersect("file_names", "table_names"))
    total = F.size("file_names") + F.size("table_names") - shared
    return (
        pairs.withColumns({"matching_columns": shared, "total_columns": total})
        .withColumn("match_percentage", F.col("matching_columns") / F.col("total_columns"))
        .where(F.col("match_percentage") > share)
    )


def match_owners(matches: DataFrame, tables: DataFrame, table: str, name: str) -> DataFrame:
    """Every table that fits each file set: (file_set, table) for all owners of the matched sets."""
    members = column_sets(tables, table, name).select(F.col("set_id").alias("table_set"), F.col("owner").alias(table))
    return matches.select("file_set", "file_example", "table_set", "match_percentage").join(members, "table_set").drop("table_set")


def match_one(header: DataFrame, tables: DataFrame, table: str, name: str, share: float = MATCH_SHARE) -> DataFrame:
    """Tables that fit one header (a relation with column ``name``), best first.

    Names of a table are made distinct before they meet the header, so a name used often joins once per table.
    """
    wanted = header.select(F.lower(name).alias("n")).distinct().withColumn("_wanted", F.lit(True))
    columns = tables.select(table, F.lower(name).alias("n")).distinct()
    hits = (
        columns.join(wanted, "n", "left")
        .groupBy(table)
        .agg(F.count("_wanted").alias("matching_columns"), F.count("*").alias("_own"))
    )
    size = wanted.agg(F.count("*")).scalar()
    scored = hits.withColumn("total_columns", F.col("_own") + size - F.col("matching_columns")).withColumn(
        "match_percentage", F.col("matching_columns") / F.col("total_columns")
    )
    return rank_candidates(scored.where(F.col("match_percentage") > share).drop("_own"), "match_percentage", [table])


def rank_candidates(matches: DataFrame, score: str, ties: list[str]) -> DataFrame:
    """Best match first; ties by name."""
    return matches.orderBy(F.desc(score), *ties)


def place_candidates(matches: DataFrame, score: str, ties: list[str]) -> DataFrame:
    """Every match with its ``place``, the best first.

    Matches are laid out by range and stored; a row's place is its place in its range plus the rows of the
    ranges before, which are counted, one number a range.
    """
    order = [F.desc(score), *ties]
    laid = matches.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = materialize(laid, "places")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = laid.groupBy(part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    starts = ranges.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = laid.withColumn("_part", part).join(starts, "_part")
    place = (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("place")
    return placed.select(*matches.columns, place)
