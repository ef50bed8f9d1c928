"""Helpers that several corpus operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refload.session import materialize

# Tasks get this subpackage's code with the function they run; executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def utf8(column: str) -> Column:
    """A text as bytes, null as no bytes. ``bytes.split()`` cuts at exactly [\\x20\\x09-\\x0D], ``lower()`` maps A-Z only."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


#: Rows that a function sees at a time: what it makes of them (lists of words) is many times their size.
ROWS = 1000


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = ROWS) -> DataFrame:
    """``fn`` over pieces of Arrow batches, at most ``rows`` rows each; nothing is kept between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, key: str, order: list[str], fn: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Deals rows out by ``key`` and gives ``fn`` many whole groups at a time, each in ``order``.

    The cost is per batch, not per group, so millions of tiny groups are fine. Memory is a batch and one group: bound
    the groups first.
    """
    dealt = df.repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            last = pc.equal(keys, keys[-1]).to_numpy(zero_copy_only=False)
            whole = int(last.argmax())
            if held and not held[-1].column(key)[-1].equals(keys[0]):
                yield fn(pa.Table.from_batches(held))
                held = []
            if whole:
                yield fn(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held = []
            held.append(batch.slice(whole))
        if held:
            yield fn(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def store(df: DataFrame, label: str) -> DataFrame:
    """``materialize`` for what comes out of a shuffle and is far smaller than the corpus, in an eighth of the files.

    Adaptive execution merges small partitions by itself where it may; this holds where it may not.
    """
    spark = df.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.coalesce(max(spark.sparkContext.defaultParallelism, shuffles // 8)), label)


def running_totals(df: DataFrame, group: list[str], order: list[str], values: list[str], label: str) -> DataFrame:
    """Adds to each row, within its group and order, ``rank`` (from 0) and for every value ``<value>_before``,
    the sum over the rows in front of it.

    Rows are laid out by range over (group, order), so that a hot group spans many partitions, and stored once:
    each piece of a group in one partition is then added up by itself and moved by what the pieces before hold.
    The number of pieces follows the number of partitions. Rows equal in ``order`` come in any order; give
    enough columns for a total one. ``df`` is read twice (its bounds are sampled), so hand in a stored relation.
    """
    spark = df.sparkSession
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    laid = df.repartitionByRange(wide, *group, *order).sortWithinPartitions(*group, *order)
    laid = materialize(laid.withColumn("_at", F.monotonically_increasing_id()), label)
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    pieces = laid.groupBy(*group, "_part").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_part").alias("_start"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}0") for v in values],
    )
    inside = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counted = laid.withColumns(
        {"_k": F.count("*").over(inside)} | {f"_{v}1": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    )
    same = F.col("_part") == F.col("_start")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = counted.join(starts, same)
    return joined.select(
        *df.columns,
        (F.col("_n0") + F.col("_k")).alias("rank"),
        *[(F.col(f"_{v}0") + F.col(f"_{v}1")).alias(f"{v}_before") for v in values],
    )


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links a-b, as links to the smallest member."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if np.array_equal(before, root):
            break
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node in a link; root is the smallest node that can be reached. ``links``: a, b (long).

    Alternating large and small stars: each round points a node's larger, then its smaller neighbours to the
    smallest one near, and needs about log(longest path) rounds. Every round is stored. A hub's rows meet its
    smallest neighbour in a join of two stored relations, which adaptive execution can split.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = store(edges, f"{label}-edges")
    while True:
        seen = edges.groupBy("u").agg(F.count("*").alias("n"))
        chained = edges.select(F.col("v").alias("u")).join(seen.select("u"), "u", "left_semi")
        if seen.filter("n > 1").select("u").union(chained).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = store(low.select("u", F.least("u", "m").alias("m")), f"{label}-low")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store(large, f"{label}-large")
        low = store(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-low")
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{label}-edges")
