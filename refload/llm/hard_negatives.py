"""Hard negatives by a vertical scan with branch and bound (BOND).

Rows and anchors are dealt out in tiles, and every pair of tiles is a group of its own. Within a group the rows lie in
columns, one a dimension. For each anchor the columns are read in the order of the anchor's magnitudes, largest first.
What the columns not yet read can add lies between sums of products with their minima and maxima, so each row's score
lies between two bounds; rows whose bounds can no longer matter leave the bitmap of candidates, and only those that stay
are read to the end. Positives are found first; their scores then give the windows that negatives have to lie in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refload.llm.common import store
from refload.session import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Negatives score between these hundredths of their positive's score.
LOW, HIGH = 50, 95
#: Rows and anchors of a pair of tiles; both are bounds, whatever the number of vectors.
ROW_TILE = 8192
ANCHOR_TILE = 4096
#: Columns read between two looks at the bounds.
STEP = 8

Found = tuple[np.ndarray, np.ndarray]
Settled = Callable[[np.ndarray, np.ndarray], np.ndarray]


def integers(lists: pa.ChunkedArray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of lists of doubles as (rows, dimensions); shorter lists end in zeros."""
    whole = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    lengths = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(scale * whole.flatten().to_numpy(zero_copy_only=False))
    return out


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays with equally many columns, in a type that holds their inner products exactly.

    That is doubles where no product can reach 2^53, else Python's whole numbers.
    """
    wide = max(a.shape[1] for a in arrays)
    padded = [np.pad(a, ((0, 0), (0, wide - a.shape[1]))) for a in arrays]
    most = max(float(np.abs(a).max(initial=0.0)) for a in padded)
    if max(wide, 1) * most * most < 2.0**53:
        return padded
    return [np.array([int(x) for x in a.ravel().tolist()], dtype=object).reshape(a.shape) for a in padded]


def kth_largest(values: np.ndarray, k: int):
    at = len(values) - k
    return np.sort(values)[at] if values.dtype == object else np.partition(values, at)[at]


class Columns:
    """A tile of rows, column by column."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.columns = np.ascontiguousarray(vectors.T)
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, anchor: np.ndarray, rows: np.ndarray, settled: Settled) -> Found:
        """(rows, scores) of the candidates ``rows`` that ``settled`` did not give up, told the bounds of their scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        ends = np.stack((a * self.low[order], a * self.high[order]))
        least, most = (e[::-1].cumsum()[::-1] for e in (ends.min(axis=0), ends.max(axis=0)))
        score = np.zeros(len(rows), dtype=self.columns.dtype)
        for at in range(0, len(order), STEP):
            own = order[at : at + STEP]
            score = score + a[at : at + STEP] @ self.columns[np.ix_(own, rows)]
            read = at + STEP
            if read < len(order):
                stays = ~settled(score + least[read], score + most[read])
                rows, score = rows[stays], score[stays]
        return rows, score


def first_rows(score: np.ndarray, ids: np.ndarray, no_id: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count``: the highest scores, equal ones by id, null ids last."""
    near = np.flatnonzero(score >= kth_largest(score, count)) if len(score) > count else np.arange(len(score))
    ranks = np.unique(score[near], return_inverse=True)[1]
    return near[np.lexsort((ids[near], no_id[near], -ranks))[:count]]


def below_best(count: int) -> Settled:
    """Gives up rows that cannot reach the lower bounds of ``count`` others."""

    def settled(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high < kth_largest(low, count) if len(low) > count else np.zeros(len(low), bool)

    return settled


def outside(windows: list[tuple[int, int, int]], count: int) -> Settled:
    """Gives up rows that are in no window, or only in such that hold ``count`` rows surely above them."""

    def settled(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        of_use = np.zeros(len(low), bool)
        for _, bottom, top in windows:
            may = (high >= bottom) & (low <= top)
            sure = low[(low >= bottom) & (high <= top)]
            if len(sure) > count:
                may &= high >= kth_largest(sure, count)
            of_use |= may
        return ~of_use

    return settled


def windows_of(scores: list[int], low: int = LOW, high: int = HIGH) -> list[tuple[int, int, int]]:
    """(positive score, least, greatest) of each distinct score whose window holds a whole number."""
    spans = [(s, -(-low * s // 100), high * s // 100) for s in sorted(set(scores), reverse=True)]
    return [w for w in spans if w[1] <= w[2]]


def _long(score) -> int:
    return max(-(2**63), min(2**63 - 1, int(score)))


class Tile:
    """The rows of a tile and the anchors that meet them, in exact numbers."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, scale: int) -> None:
        self.anchors, vectors = exact(integers(anchors.column("vector"), scale), integers(rows.column("vector"), scale))
        self.columns = Columns(vectors)
        self.row = rows.column("row").to_numpy()
        self.no_id = rows.column("id").is_null().to_numpy()
        self.ids = rows.column("id").fill_null(0).to_numpy()

    def found(self, rows: np.ndarray, score: np.ndarray, count: int) -> list[tuple[int | None, int]]:
        """(id, score) of the first ``count`` of these rows."""
        at = first_rows(score, self.ids[rows], self.no_id[rows], count)
        return [(None if self.no_id[rows[i]] else int(self.ids[rows[i]]), _long(score[i])) for i in at.tolist()]


def _meet(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], keys: list[str], fn, schema: str) -> DataFrame:
    """``fn(anchors, rows)`` of every pair of tiles of equal ``keys``.

    Tiles are dealt by a hash of the row's number, which no two rows share, so that repeated ids and hot labels
    make no large tile; the number of tiles follows the number of rows.
    """
    row_tiles, anchor_tiles = (-(-n // tile) for n, tile in zip(sizes, (ROW_TILE, ANCHOR_TILE), strict=True))

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("row"), F.lit(max(parts, 1))).cast("int")
        return df.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(max(others, 1) - 1))))

    left = dealt(anchors, "anchor_tile", anchor_tiles, "row_tile", row_tiles).groupBy(*keys, "row_tile", "anchor_tile")
    right = dealt(rows, "row_tile", row_tiles, "anchor_tile", anchor_tiles).groupBy(*keys, "row_tile", "anchor_tile")
    empty = pa.table({n: pa.array([], pa.int64()) for n in schema.replace(" long", "").split(", ")})

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return fn(a, b) if a.num_rows and b.num_rows else empty

    return left.cogroup(right).applyInArrow(run, schema)


def _table(made: list[tuple], schema: str) -> pa.Table:
    names = schema.replace(" long", "").split(", ")
    return pa.table({n: pa.array([m[i] for m in made], pa.int64()) for i, n in enumerate(names)})


def _positives(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], count: int, scale: int) -> DataFrame:
    """(anchor, positive_id, positive_score), the first ``count`` other rows of each anchor's label."""
    schema = "anchor long, positive_id long, positive_score long"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        tile, made = Tile(a, b, scale), []
        for number, vector in zip(a.column("row").to_pylist(), tile.anchors, strict=True):
            rows, score = tile.columns.scan(vector, np.flatnonzero(tile.row != number), below_best(count))
            made += [(number, *f) for f in tile.found(rows, score, count)]
        return _table(made, schema)

    found = _meet(anchors, rows, sizes, ["label"], run, schema)
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= count)


def _negatives(
    anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], count: int, low: int, high: int, scale: int
) -> DataFrame:
    """(anchor, positive_score, negative_id, negative_score, rank) of every window, a window for each score of ``scores``."""
    schema = "anchor long, positive_score long, negative_id long, negative_score long"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        tile, made = Tile(a, b, scale), []
        labels = b.column("label").dictionary_encode().combine_chunks()
        codes, of = labels.indices.to_numpy(), {v: i for i, v in enumerate(labels.dictionary.to_pylist())}
        given = (a.column(c).to_pylist() for c in ("row", "label", "scores"))
        for number, label, scores, vector in zip(*given, tile.anchors, strict=True):
            windows = windows_of(scores, low, high)
            if not windows:
                continue
            rows, score = tile.columns.scan(vector, np.flatnonzero(codes != of.get(label, -1)), outside(windows, count))
            for positive, bottom, top in windows:
                inside = (score >= bottom) & (score <= top)
                made += [(number, positive, *f) for f in tile.found(rows[inside], score[inside], count)]
        return _table(made, schema)

    found = _meet(anchors, rows, sizes, [], run, schema)
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as floor(``scale`` * x), scores are inner products of these, exact; a score beyond the range of a
    long counts as the end of that range. An anchor's positives are the first ``positives`` other rows of its label, its
    negatives for a positive the first ``negatives`` rows of other labels that score from ``low`` to ``high`` hundredths of it.

    Rows with a null label, a null vector or a component that is null or not finite (scaled) take no part. Shorter vectors end
    in zeros. Rows, not ids, are compared: a copy of an anchor is another row and may be its positive, repeated anchors give
    repeated results, null ids come last among equal scores. Anchors without a positive or a row in the window give no row,
    an empty table none at all. Columns beyond the three named are not looked at, save by ``is_anchor``.
    """
    value = F.col("vector")
    fits = F.coalesce(F.forall(value, lambda x: F.abs(x) * scale < float("inf")), F.lit(False))
    taken = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    taken = taken.filter(F.col("label").isNotNull() & fits).withColumn("row", F.monotonically_increasing_id())
    taken = materialize(taken, "negatives-rows")
    anchors, rows = taken.filter("is_anchor").select("row", "id", "label", "vector"), taken.select("row", "id", "label", "vector")
    told = taken.agg(F.count("*"), F.count_if("is_anchor")).first()
    sizes = (told[0], told[1])
    near = store(_positives(anchors, rows, sizes, positives, scale).drop("place"), "negatives-positives")
    scores = near.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("positive_score").alias("scores"))
    asked = store(anchors.join(scores, "row"), "negatives-anchors")
    far = _negatives(asked, rows, sizes, negatives, low, high, scale)
    named = near.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.join(far, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


#: The same rows in DuckDB, every anchor against every row.
HARD_NEGATIVES_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
  n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
      row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
      AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
  SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
