"""Unique column names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values --------------------------------------------------------------------------------------
# Headers that a task numbers at a time: the names in Python are many times the size of the text.
HEADERS = 1000
# ---------------------------------------------------------------------------------------------------


def dedupe_header(names: Column) -> Column:
    """Array of names with ``_1``, ``_2``... added to repeats, passing over names already given.

    Names are compared without case, as tables do. Blank names stay blank. Works name by name, because a suffix
    may hit a name given earlier.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("given"), F.array().cast("array<string>").alias("low"),
        F.create_map().cast("map<string,int>").alias("used"),
    )

    def step(acc: Column, name: Column) -> Column:
        low, used, key = acc["low"], acc["used"], F.lower(name)
        last = F.coalesce(used[key], F.lit(0))
        stem = F.concat(key, F.lit("_"))
        taken = F.filter(low, lambda x: x.startswith(stem))
        tries = F.transform(F.sequence(last + 1, last + 1 + F.size(taken)), lambda k: F.concat(stem, k.cast("string")))
        free = F.get(F.array_except(tries, taken), F.lit(0))
        repeated = (name != "") & F.array_contains(low, key)
        counter = F.substring(free, F.length(stem) + 1, F.length(free)).cast("int")
        counted = F.map_concat(F.map_filter(used, lambda k, v: k != key), F.create_map(key, counter))
        chosen = F.when(repeated, F.concat(name, F.lit("_"), counter.cast("string"))).otherwise(name)
        return F.struct(
            F.concat(acc["given"], F.array(chosen)).alias("given"), F.concat(low, F.array(F.lower(chosen))).alias("low"),
            F.when(repeated, counted).otherwise(used).alias("used"),
        )

    return F.aggregate(names, start, step)["given"]


def number_headers(names: Column) -> Column:
    """``dedupe_header`` for many headers: one pass over the names of each, in Arrow batches.

    The names in lower case come from Spark, so that both ways compare alike. Null names stay null.
    """

    def numbered(header: Iterable[tuple[str | None, str | None]]) -> Iterator[str | None]:
        last: dict[str, int] = {}  # the last number of each name given
        for name, key in header:
            if not name:
                yield name
                continue
            if key not in last:
                last[key] = 0
                yield name
                continue
            n = last[key] + 1
            while (low := f"{key}_{n}") in last:
                n += 1
            last[key], last[low] = n, 0
            yield f"{name}_{n}"

    def piece(given: pa.Array, keys: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(given), 0)
        words = (x.flatten().to_numpy(zero_copy_only=False).tolist() for x in (given, keys))  # far faster than to_pylist
        pairs = zip(*words, strict=True)
        flat = [x for size in sizes.to_pylist() for x in numbered(islice(pairs, size))]
        ends = pc.cumulative_sum(sizes).cast(pa.int32())
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.string()), mask=given.is_null())

    @F.arrow_udf("array<string>")
    def header(given: pa.Array, keys: pa.Array) -> pa.Array:
        starts = range(0, len(given), rows)
        pieces = [piece(given.slice(at, rows), keys.slice(at, rows)) for at in starts]
        return pa.concat_arrays(pieces) if pieces else pa.array([], pa.list_(pa.string()))

    rows = HEADERS
    return header(names, F.transform(names, F.lower))


def dedupe_names(columns: DataFrame, file: str, position: str, name: str) -> DataFrame:
    """The same over a relation of one row per column: add ``unique_name``.

    Repeats are numbered within (file, name without case). One shuffle by file serves all windows: the columns
    of a file are as many as fit into its header line. A numbered name that equals another name of its file shows as a
    name given twice; only the headers of such files are gathered, one array per file. Rows without a file are no
    header: they are numbered and nothing is passed over.
    """
    kept = columns.columns
    repeat = F.row_number().over(Window.partitionBy(file, F.lower(name)).orderBy(position)) - 1
    numbered = columns.repartition(file).withColumn("_repeat", F.when(F.col(name) == "", F.lit(0)).otherwise(repeat))
    plain = F.when(F.col("_repeat") == 0, F.col(name)).otherwise(F.concat(name, F.lit("_"), F.col("_repeat")))
    numbered = numbered.withColumn("unique_name", plain).drop("_repeat")
    given = F.count(F.lit(1)).over(Window.partitionBy(file, F.lower("unique_name")))
    twice = F.col(file).isNotNull() & (F.col("unique_name") != "") & (given > 1)
    marked = numbered.withColumn("_twice", F.coalesce(twice, F.lit(False)))
    marked = marked.withColumn("_clash", F.max("_twice").over(Window.partitionBy(file)))
    smooth = marked.where(~F.col("_clash")).select(*kept, "unique_name")
    column = F.struct(F.col(position).alias("_p"), F.col(name).alias("_n"), F.struct(*kept).alias("_row"))
    walked = (
        marked.where("_clash")
        .groupBy(file)
        .agg(F.array_sort(F.collect_list(column)).alias("_cols"))
        .withColumn("_given", number_headers(F.transform("_cols", lambda c: c["_n"])))
        .select(F.explode(F.arrays_zip("_cols", "_given")).alias("_z"))
        .select("_z._cols._row.*", F.col("_z._given").alias("unique_name"))
    )
    return smooth.unionByName(walked)


def dedupe_headers(headers: DataFrame, file: str, names: Column) -> DataFrame:
    """The same over a relation of one row per header: ``file``, ``pos`` (from 0) and ``unique_name`` of every name.

    The row of a file is numbered where it lies. Files that come in several rows, and rows without a file, are put
    together by position as ``dedupe_names`` does.
    """
    rows = F.when(F.col(file).isNull(), F.lit(0)).otherwise(F.count(F.lit(1)).over(Window.partitionBy(file)))
    # As many partitions as shuffles have: adaptive execution would merge them by their bytes, which are few for the work in them.
    partitions = int(headers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = headers.repartition(partitions, file).withColumn("_rows", rows)
    alone = F.col("_rows") == 1
    whole = counted.where(alone).select(file, names.alias("_names"))
    whole = whole.select(file, F.posexplode(number_headers(F.col("_names"))).alias("pos", "unique_name"))
    parts = counted.where(~alone).select(file, F.posexplode(names).alias("pos", "_name"))
    return whole.unionByName(dedupe_names(parts, file, "pos", "_name").drop("_name"))
