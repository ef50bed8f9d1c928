"""Near-duplicate vectors through an inverted multi-index.

Vectors of length one are cut into halves; a codebook for each half, and the pairs of codewords are the cells of a
product grid. A vector lives in the cell of its two nearest codewords. To find its neighbours it visits cells in the
order of a lower bound on their distance (multi-sequence: the next cell is always one step along one of the two
sorted lists), until no farther cell can add to the recall that is wanted; what lies in the visited cells is verified
by its cosine.

The bound of a cell: whoever lives with codeword c of a half is nearer to c than to my own codeword o, so it lies
beyond the plane midway between them, at (|x - c|^2 - |x - o|^2) / (2 |c - o|) from me. The two halves' bounds add up
as squares. For a target recall of 1 the walk ends where the bound passes the largest distance a link can have, and
every link is found. For less it ends where it has passed what that share of links needs, links of the sample and links
made for it: sampled vectors turned by the widest angle of a link in random directions. A link counts for both of its
ends if either walk finds it, so more are found than the target says.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refload.llm.common import components, map_batches, map_groups, stars
from refload.session import materialize

THRESHOLD = 0.98
RECALL = 0.999
#: Vectors that the codebooks are fitted on, at most; all vectors are indexed.
SAMPLE = 16_384
#: Codewords of a half grow with the square root of the vectors over this, up to the next figure.
PER_CELL = 256
MOST_WORDS = 256
#: Members or visitors of a cell in one task; larger cells are dealt out as pairs of blocks.
BLOCK = 1024


def unit(vector: list | None) -> list[float] | None:
    """The vector at length one, in double precision; None for null, empty, zero, and null or non-finite components."""
    if not vector or None in vector:
        return None
    x = np.array(vector, dtype=float)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return (x / np.sqrt(x @ x) + 0.0).tolist()


def codebook(x: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """k-means from spread-out rows; ``x`` comes in a hashed order, so its first rows are a random start."""
    words = max(1, min(words, len(x)))
    centers = x[:words].copy()
    for _ in range(rounds):
        near = _squares(x, centers).argmin(axis=1)
        counts = np.bincount(near, minlength=words)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
    return np.unique(centers, axis=0)


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


def bounds(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and squared lower bounds on the distance to what lives with each codeword."""
    squares = _squares(x, centers)
    own = squares.argmin(axis=1)
    apart = np.sqrt(_squares(centers, centers))[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        low = (squares - squares.min(axis=1)[:, None]) / (2 * apart)
    low[np.arange(len(x)), own] = 0
    return own, np.maximum(low, 0) ** 2


def multi_sequence(low1: np.ndarray, low2: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Cells in the order of their bounds, up to ``reach``."""
    order1, order2 = np.argsort(low1, kind="stable"), np.argsort(low2, kind="stable")
    s1, s2 = low1[order1].tolist(), low2[order2].tolist()
    heap, cells = [(s1[0] + s2[0], 0, 0)], []
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > reach:
            break
        cells.append((int(order1[i]), int(order2[j])))
        if i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if i == 0 and j + 1 < len(s2):
            heapq.heappush(heap, (s1[0] + s2[j + 1], 0, j + 1))
    return cells


def fit(sample: np.ndarray, words: int, threshold: float, recall: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Both codebooks, and how far a walk has to go."""
    half = sample.shape[1] // 2
    books = codebook(sample[:, :half], words), codebook(sample[:, half:], words)
    farthest = 2 * (1 - threshold) + 1e-9
    if recall >= 1:
        return *books, farthest
    (own1, low1), (own2, low2) = bounds(sample[:, :half], books[0]), bounds(sample[:, half:], books[1])
    reach = 0.0
    for at in range(0, len(sample), 1024):
        i, j = np.nonzero(sample[at : at + 1024] @ sample.T >= threshold)
        i, j = i[i + at != j] + at, j[i + at != j]
        if len(i):
            reach = max(reach, float(np.quantile(low1[i, own1[j]] + low2[i, own2[j]], recall, method="higher")))
    rng = np.random.default_rng(0)
    turned = rng.normal(size=sample.shape)
    turned -= (turned * sample).sum(axis=1)[:, None] * sample
    size = np.sqrt((turned * turned).sum(axis=1))[:, None]
    turned = threshold * sample + np.sqrt(1 - threshold**2) * turned / np.maximum(size, 1e-12)
    to1, to2 = bounds(turned[:, :half], books[0])[0], bounds(turned[:, half:], books[1])[0]
    rows = np.arange(len(sample))
    reach = max(reach, float(np.quantile(low1[rows, to1] + low2[rows, to2], recall, method="higher")))
    return *books, min(reach, farthest)


def vector_links(classes: DataFrame, threshold: float, recall: float, block: int, seed: int = 7) -> DataFrame:
    """(a, b, n): where b is null, ``a`` has links to n rows more in one cell; else a link of a spanning star.

    ``classes``, stored: id, label (string), unit (all of one length), n rows that are equal.
    """
    count = classes.count()
    words = int(np.clip(round((count / PER_CELL) ** 0.5), 1, MOST_WORDS))
    first = classes.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).select("unit").toArrow()
    sample = np.array(first.column("unit").to_pylist(), dtype=float)
    book1, book2, reach = fit(sample, words, threshold, recall)
    half = sample.shape[1] // 2

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column("unit").to_pylist(), dtype=float)
        (own1, low1), (own2, low2) = bounds(x[:, :half], book1), bounds(x[:, half:], book2)
        walks = [[i * len(book2) + j for i, j in multi_sequence(a, b, reach)] for a, b in zip(low1, low2, strict=True)]
        cells = pa.array(own1 * len(book2) + own2, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("id", "label", "unit", "n")), cells, pa.array(walks, pa.list_(pa.int64()))],
            names=["id", "label", "unit", "n", "cell", "walk"],
        )

    schema = "id long, label string, unit array<double>, n long, cell long, walk array<long>"
    indexed = materialize(map_batches(classes.select("id", "label", "unit", "n"), place, schema), "vectors-indexed")
    visits = indexed.select("id", "label", F.explode("walk").alias("cell"))
    members = indexed.groupBy("label", "cell").agg(F.count("*").alias("members"))
    load = visits.groupBy("label", "cell").agg(F.count("*").alias("visitors")).join(members, ["label", "cell"])
    load = load.filter("visitors > 1").select(
        "label", "cell", *[F.ceil(F.col(c) / block).cast("int").alias(f"{c}_cut") for c in ("members", "visitors")]
    )
    load = materialize(load, "vectors-load")

    def dealt(rows: DataFrame, role: int) -> DataFrame:
        mine, others = ("members_cut", "visitors_cut") if role == 0 else ("visitors_cut", "members_cut")
        own = F.pmod(F.xxhash64("id"), F.col(mine))
        cut = rows.join(load, ["label", "cell"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        pair = (own, F.col("other")) if role == 0 else (F.col("other"), own)
        group = F.concat_ws(":", "cell", *[p.cast("string") for p in pair], "label")
        return cut.select(group.alias("group"), F.lit(role).alias("role"), "id", "unit", "n", "home")

    indexed = indexed.withColumn("home", F.col("cell"))
    visiting = indexed.select("id", "label", "unit", "n", "home", F.explode("walk").alias("cell"))
    both = dealt(indexed, 0).unionByName(dealt(visiting, 1))

    def verify(table: pa.Table) -> pa.RecordBatch:
        keys = table.column("group").combine_chunks().dictionary_encode().indices.to_numpy()
        role, ids, n, home = (table.column(c).to_numpy() for c in ("role", "id", "n", "home"))
        flat = table.column("unit").combine_chunks().flatten().to_numpy()
        x = flat.reshape(len(ids), -1)
        edges = np.flatnonzero(np.diff(keys)) + 1
        out_a, out_b, out_n = [], [], []
        for lo, hi in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(ids)])), strict=True):
            cut = lo + int(np.searchsorted(role[lo:hi], 1))
            if lo == cut or cut == hi:
                continue
            hit = (x[cut:hi] @ x[lo:cut].T >= threshold) & (ids[cut:hi, None] != ids[lo:cut])
            if not hit.any():
                continue
            i, j = np.nonzero(hit)
            i, j = cut + i, lo + j
            # A link that the member's own walk does not find is counted for the member here.
            near = np.unique(j)
            (_, low1), (_, low2) = bounds(x[near, :half], book1), bounds(x[near, half:], book2)
            at = np.searchsorted(near, j)
            alone = low1[at, home[i] // len(book2)] + low2[at, home[i] % len(book2)] > reach
            ends, others = np.concatenate((i, j[alone])), np.concatenate((j, i[alone]))
            own, which = np.unique(ends, return_inverse=True)
            out_a.append(ids[own])
            out_b.append(np.full(len(own), np.iinfo(np.int64).min))
            out_n.append(np.bincount(which, weights=n[others]).astype(np.int64))
            a, b = stars(ids[i], ids[j])
            out_a.append(a)
            out_b.append(b)
            out_n.append(np.zeros(len(a), np.int64))
        a, b, c = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (out_a, out_b, out_n))
        none = b == np.iinfo(np.int64).min
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=none), pa.array(c)], names=["a", "b", "n"])

    return map_groups(both, "group", ["role", "id"], verify, "a long, b long, n long")


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """(id, label, n_links, component_id, kept), one row for every row of ``vectors``.

    Rows are compared where their labels are equal and not null and their vectors as long as one another; null, empty
    and zero vectors and those with null or non-finite components have no links. Equal vectors of a label are one
    class: found, compared and counted once. n_links counts other rows; a null id takes no part (no links, no
    component, not kept); rows with the same id are one node of the graph. An empty table gives no rows.
    """
    asked = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"),
        F.col(label_column).alias("given"), F.col(vector_column).cast("array<double>").alias("vector"),
    )

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        usable = zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), strict=True)
        found = [
            unit(v) if i is not None and tag is not None else None
            for (i, tag), v in zip(usable, batch.column("vector").to_pylist(), strict=True)
        ]
        columns = [batch.column(c) for c in ("id", "label", "given")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.float64()))], names=["id", "label", "given", "unit"])

    kind = vectors.schema[label_column].dataType.simpleString()
    rows = map_batches(asked, clean, f"id long, label string, given {kind}, unit array<double>")
    rows = materialize(rows.withColumn("print", F.xxhash64("label", "unit")), "vectors-rows")
    usable = rows.filter(F.col("unit").isNotNull())
    classes = usable.groupBy("label", "unit").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("print").alias("print"))
    classes = materialize(classes, "vectors-classes")
    lengths = [r[0] for r in classes.select(F.size("unit").alias("s")).distinct().collect()]
    spark = vectors.sparkSession
    found = None
    for length in sorted(lengths):  # nearly always one
        part = classes.filter(F.size("unit") == length)
        links = vector_links(part, threshold, recall, block)
        found = links if found is None else found.union(links)
    if found is None:
        found = spark.createDataFrame([], "a long, b long, n long")
    found = materialize(found, "vectors-links")
    held = classes.select("print", F.col("unit").alias("of"), F.col("label").alias("tag"), F.col("id").alias("class"), "n")
    equal = (rows["print"] == held["print"]) & (F.col("unit") == F.col("of")) & (F.col("label") == F.col("tag"))
    classed = materialize(rows.join(held, equal, "left").select("id", "given", "class", "n"), "vectors-classed")
    copies = classed.filter("id != class").select(F.col("id").alias("a"), F.col("class").alias("b"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b").union(copies), "vectors")
    roots = materialize(roots, "vectors-roots")
    more = materialize(found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("more")), "vectors-counts")
    counted = classed.join(more, F.col("class") == F.col("a"), "left")
    counted = counted.withColumn("links", F.col("n") - 1 + F.coalesce("more", F.lit(0)))
    named = counted.join(roots, F.col("id") == F.col("node"), "left")
    component = F.coalesce("root", "id")
    return named.select(
        F.col("id").alias(id_column), F.col("given").alias(label_column), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
