"""Packing documents into training sequences of several permitted lengths.

A document longer than the longest sequence fills whole sequences and leaves a tail. Tails are packed best-fit: the
longest first, each into the open bin with the least room that still holds it. Where none does, a bin is opened of the
size that costs least per word it can expect: its cost over the tail and what the tails still to come would fill it
with. At the end every bin shrinks to the shortest permitted length that holds its contents.

Tails are dealt out by a hash into groups of GROUP, each packed by itself in one task; the price is that of one group's
last bins, and packing takes a bounded amount of memory whatever the corpus.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refload.llm.common import running_totals, store
from refload.session import materialize

CAPACITIES = (512, 1024, 2048, 4096)
GROUP = 8192
WORD = r"[^\x20\x09-\x0D]+"


def sequence_cost(capacity: int) -> float:
    """Cost of a sequence: its length, attention that grows with the square, and a fixed part."""
    return capacity * (1 + capacity / 65_536) + 16


def expected_fill(room: int, lengths: list[int], top: int) -> int:
    """What the first ``top`` of ascending ``lengths`` would fill of ``room``, largest first."""
    left = room
    while left > 0 and top > 0:
        top = bisect_right(lengths, left, 0, top)
        if not top:
            break
        top -= 1
        left -= lengths[top]
    return room - left


def best_fit(
    lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost
) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every item, and the capacity of every bin. Items are at most the largest capacity long."""
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    rising = sorted(lengths)
    open_bins: list[tuple[int, int]] = []  # room left, bin
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    filled: list[int] = []
    for done, i in enumerate(order):
        length = lengths[i]
        k = bisect_left(open_bins, (length, -1))
        if k < len(open_bins):
            room, b = open_bins.pop(k)
        else:
            rest = len(lengths) - done - 1
            best = min(
                (c for c in sizes if c >= length),
                key=lambda c: (cost(c) / (length + expected_fill(c - length, rising, rest)), c),  # noqa: B023
            )
            room, b = best, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += length
        if room > length:
            insort(open_bins, (room - length, b))
    return bins, offsets, [sizes[bisect_left(sizes, f)] for f in filled]


def pack(
    docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group: int = GROUP, seed: int = 3,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, text_crc32, piece, from_word, n_words, bin_id, offset, capacity): where every word of every row goes.

    A row a piece; pieces of a text follow one another from word 0. Rows without words (null and empty texts) have one
    row with no words and no bin. Equal rows are packed each by itself; ids may be null. The result hangs on ids,
    checksums and the seed alone. An empty table gives no rows.
    """
    longest = max(capacities)
    text = F.coalesce(F.col(text_column), F.lit(""))
    facts = docs.select(
        F.col(id_column).alias("id"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )
    facts = materialize(facts.withColumn("key", F.xxhash64(F.lit(seed), "id", "text_crc32")), "packing-facts")
    ranked = running_totals(facts, [], ["key", "id", "text_crc32", "size"], [], "packing-order")
    ranked = store(ranked.select("id", "text_crc32", "size", "rank"), "packing-ranks")
    pieces = F.expr(f"size div {longest}")
    whole = ranked.withColumn("pieces", pieces).filter("pieces > 0")
    whole = whole.select("id", "text_crc32", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    whole = whole.select(
        "id", "text_crc32", "piece", (F.col("piece") * longest).alias("from_word"), F.lit(longest).alias("n_words"),
        F.concat(F.lit("d"), "rank", F.lit("."), "piece").alias("bin_id"), F.lit(0).alias("offset"), F.lit(longest).alias("capacity"),
    )
    empty = ranked.filter("size = 0").select(
        "id", "text_crc32", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("from_word"), F.lit(0).alias("n_words"),
        F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("int").alias("capacity"),
    )
    tails = ranked.withColumn("n_words", (F.col("size") % longest).cast("int")).filter("n_words > 0")
    tails = tails.select(
        "id", "text_crc32", pieces.alias("piece"), (pieces * longest).alias("from_word"), "n_words", "rank",
        F.expr(f"rank div {group}").alias("part"),
    )
    kind = docs.schema[id_column].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        bins, offsets, sizes = best_fit(rows["n_words"].tolist(), capacities)
        made = rows.drop(columns=["rank", "part"])
        made["bin_id"] = [f"g{key[0]}.{b}" for b in bins]
        made["offset"] = offsets
        made["capacity"] = np.array(sizes)[bins]
        return made

    schema = f"id {kind}, text_crc32 long, piece long, from_word long, n_words int, bin_id string, offset int, capacity int"
    packed = tails.groupBy("part").applyInPandas(run, schema)
    return packed.union(whole).union(empty).withColumnRenamed("id", id_column)
