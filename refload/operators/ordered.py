"""Running computations over the scans of a file.

A file watched for long may own a large share of all scans. Its scans are cut into time chunks that are
worked on apart; what a chunk needs to know of the past is summed up in one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: equal looks in a row after which a file is ready.
STABLE_SCANS = 6


def stable_files(
    scans: DataFrame,
    path: str,
    order: list[str],
    watched: list[str],
    chunk: Column,
    needed: int = STABLE_SCANS,
) -> DataFrame:
    """Add ``stable_count`` and ``is_stable``: how many scans in a row, up to this one, saw the same file.

    The count is the scan's number minus the number of the last change plus one. Both come from windows
    within (file, chunk); the totals, the last state and the last change of earlier chunks are carried over
    by a window on the chunk rows. ``chunk`` must not fall as ``order`` rises.
    """
    state = F.struct(*[F.col(c) for c in watched])
    place = F.struct(*[F.col(c) for c in order])
    rows = scans.withColumn("_chunk", chunk)
    local = Window.partitionBy(path, "_chunk").orderBy(*order)
    so_far = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag(state).over(local)
    rows = rows.withColumn("_n", F.row_number().over(local))
    rows = rows.withColumn("_change", F.when(before.isNotNull() & ~before.eqNullSafe(state), F.col("_n")))
    rows = rows.withColumn("_last", F.max("_change").over(so_far))

    chunks = rows.groupBy(path, "_chunk").agg(
        F.count("*").alias("_size"),
        F.min_by(state, place).alias("_first_state"),
        F.max_by(state, place).alias("_last_state"),
        F.max("_change").alias("_chunk_change"),
    )
    timeline = Window.partitionBy(path).orderBy("_chunk")
    earlier = timeline.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    starts_new = ~F.lag("_last_state").over(timeline).eqNullSafe(F.col("_first_state"))
    chunks = chunks.withColumn("_start_change", F.when(starts_new, F.col("_before") + 1))
    newest = F.coalesce(F.col("_before") + F.col("_chunk_change"), F.col("_start_change"))
    chunks = chunks.withColumn("_newest", newest)
    chunks = chunks.withColumn("_carried", F.coalesce("_start_change", F.max("_newest").over(earlier)))

    joined = rows.join(chunks.select(path, "_chunk", "_before", "_carried"), [path, "_chunk"])
    last_change = F.coalesce(F.col("_before") + F.col("_last"), F.col("_carried"))
    counted = joined.withColumn("stable_count", F.col("_before") + F.col("_n") - last_change + 1)
    return counted.withColumn("is_stable", F.col("stable_count") >= needed).select(
        *scans.columns, "stable_count", "is_stable"
    )
