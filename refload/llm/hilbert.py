"""Shards along a Hilbert curve over several metadata columns.

Each dimension is cut at its own quantiles into ``2 ** bits`` steps, the steps of a row are one point of a grid, and
rows are sorted by the place of that point on the Hilbert curve. Runs of that order become shards, so that a shard
covers a compact box in all dimensions and filters on any of them skip most files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refload.llm.common import running_totals
from refload.session import materialize

BITS = 8
#: Relative rank error of a cut is at most one in this many.
ACCURACY = 10_000


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, rank): the distinct values of a column in their order, numbered by range; nulls have none.

    A string is placed by the whole of it, however much it shares with others at its start.
    """
    values = materialize(df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct(), "hilbert-values")
    return running_totals(values, [], ["value"], [], "hilbert-value-order").select("value", F.col("rank").cast("double").alias("rank"))


def with_codes(facts: DataFrame, codes: list[str]) -> DataFrame:
    """Columns ``codes`` as numbers in the order of their values: numbers and times as they are, strings by rank."""
    for code in codes:
        if isinstance(facts.schema[code].dataType, T.StringType):
            ranks = value_ranks(facts, code)
            facts = facts.join(ranks, F.col(code) == F.col("value"), "left").withColumn(code, F.col("rank")).drop("value", "rank")
        else:
            facts = facts.withColumn(code, F.col(code).cast("double"))
    return facts


def curve_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows, dimensions), after Skilling's transposed form."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def with_curve(df: DataFrame, codes: list[str], bits: int = BITS) -> DataFrame:
    """Adds ``curve``, the place of each row's numbers ``codes`` on the curve. Nulls stand below the first cut.

    The cuts, ``2 ** bits - 1`` numbers a dimension, are all that reaches the driver.
    """
    at = [i / 2**bits for i in range(1, 2**bits)]
    found = df.agg(*[F.percentile_approx(c, at, ACCURACY).alias(f"c{i}") for i, c in enumerate(codes)]).first()
    cuts = [np.array(found[i] or [], dtype=float) for i in range(len(codes))]

    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        steps = [np.where(s.isna(), 0, np.searchsorted(c, s.fillna(0))) for s, c in zip(columns, cuts, strict=True)]
        return pd.Series(curve_index(np.stack(steps, axis=1), bits))

    return df.withColumn("curve", place(*codes))


def hilbert_shards(
    docs: DataFrame, dims: list[str], shards: int = 16, law: str = "rows", bits: int = BITS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, size, text_crc32, curve, shard, slot) of every row.

    ``law`` "rows": shard counts differ by one at most. "bytes": a shard ends with the row that takes the running
    size over its even part. Ties on the curve are ordered by id, checksum and size, so equal rows may stand in any
    order and a hot point of the curve is cut like any other run. Null texts are empty (size 1, checksum 0); null ids
    come first; an empty table gives no rows. Columns of ``docs`` beyond the named ones are not looked at.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    text = F.coalesce(F.col(text_column), F.lit(""))
    codes = [F.col(d).alias(f"code{i}") for i, d in enumerate(dims)]
    facts = docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *codes,
    )
    facts = materialize(facts, "hilbert-facts")
    names = [f"code{i}" for i in range(len(dims))]
    if any(isinstance(facts.schema[n].dataType, T.StringType) for n in names):
        facts = materialize(with_codes(facts, names), "hilbert-codes")
    else:
        facts = with_codes(facts, names)
    placed = with_curve(facts, names, bits)
    placed = materialize(placed.select("id", "size", "text_crc32", "curve"), "hilbert-curve")
    order = ["curve", "id", "text_crc32", "size"]
    ranked = materialize(running_totals(placed, [], order, ["size"], "hilbert-order"), "hilbert-ranks")
    total = ranked.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    if law == "rows":
        part = F.expr(f"rank * {shards} div {max(total.n, 1)}")
    else:
        part = F.expr(f"size_before * {shards} div {max(total.b or 0, 1)}")
    dealt = ranked.withColumn("shard", part.cast("int"))
    first = dealt.groupBy("shard").agg(F.min("rank").alias("first"))  # at most ``shards`` rows
    return dealt.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_column), "size", "text_crc32", "curve", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )


def write_shards(docs: DataFrame, dealt: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """The documents as one folder per shard, in slot order. Ids must be unique."""
    placed = docs.join(dealt.select(id_column, "shard", "slot"), id_column)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)


def shard_boxes(docs: DataFrame, dealt: DataFrame, dims: list[str], id_column: str = "doc_id") -> DataFrame:
    """Smallest and largest value of every dimension in every shard: what a reader prunes by."""
    placed = docs.select(id_column, *dims).join(dealt.select(id_column, "shard"), id_column)
    return placed.groupBy("shard").agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])
