"""Mixing sources to target weights along a time-varying curriculum.

A source has a weight at every moment of the training (time 0 to 1). Integrated, the weights say how many tokens of
the source have been asked for by a given time; inverted, at which time the source's n-th token is due. Every
document thus has a place of its own in the training, and sorting by it gives the mixed stream: no source is dealt
out by a loop, and any part of the stream can be made by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refload.llm.common import running_totals
from refload.session import local_rows, materialize

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Ramp:
    """A weight that goes straight from ``start`` to ``end`` over the training; only their ratio matters."""

    start: float
    end: float


#: Sources of the weights 3, 1, 2: the heaviest come in late, the lightest stay level, the middle ones fade.
RAMPS = (Ramp(0.5, 1.5), Ramp(1.0, 1.0), Ramp(1.5, 0.5))
WEIGHTS = (3, 1, 2)


def water_level(sizes: list[int], weights: list[int], share: float, repeats: float) -> list[float]:
    """Targets by weight that add up to ``share`` of all sizes, none above ``repeats`` times its source's size.

    What a full source cannot take goes to the others by weight. Filling sources in the order of room per weight
    gives the level at once: the first level that the next source can hold is the one.
    """
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i] / weights[i], i))
    wanted, left, heavy = share * sum(sizes), 0.0, sum(weights)
    level = 0.0
    for i in order:
        level = (wanted - left) / heavy
        if level * weights[i] <= repeats * sizes[i]:
            break
        left += repeats * sizes[i]
        heavy -= weights[i]
    return [min(level * w, repeats * s) if heavy else repeats * s for s, w in zip(sizes, weights, strict=True)]


def due(part: Column, start: Column, end: Column) -> Column:
    """The time at which ``part`` (0 to 1) of a source's tokens has been asked for, its weight going start to end.

    The demand is the integral (start * t + (end - start) * t^2 / 2) over (start + end) / 2; this is its inverse, in
    the form that holds for level weights too.
    """
    mean = (start + end) / 2
    root = F.sqrt(F.greatest(start * start + 2 * (end - start) * part * mean, F.lit(0.0)))
    return F.when(part <= 0, F.lit(0.0)).otherwise(F.least(2 * part * mean / (start + root), F.lit(1.0)))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[Ramp, ...] = RAMPS, share: float = 1.5, repeats: float = 2.0
) -> DataFrame:
    """(source, source_size, target, start, end), a row a source; these rows alone pass the driver.

    Sources in the order of their code points, null last, take weights and ramps in turn.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    own = [weights[i % len(weights)] for i in range(len(found))]
    targets = water_level([r["size"] for r in found], own, share, repeats)
    rows = [
        (r.source, r["size"], repr(t), repr(float(ramps[i % len(ramps)].start)), repr(float(ramps[i % len(ramps)].end)))
        for i, (r, t) in enumerate(zip(found, targets, strict=True))
    ]
    made = local_rows(sizes.sparkSession, rows, "source string, source_size long, target string, start string, end string")
    return made.withColumns({c: F.col(c).cast("double") for c in ("target", "start", "end")})


def curriculum(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[Ramp, ...] = RAMPS, share: float = 1.5,
    repeats: int = 2, seed: int = 1, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, source, size, text_crc32, source_size, target, taken, passes), a row a document.

    ``passes`` are (pass, words, position): the times that the document is read, how many of its words from the front,
    and when, from 0 to 1. Each source is read through in a hashed order as often as its target holds it whole, then
    once more until the target is met, to the nearest word: the last document is cut. A document is read ``repeats`` times
    at most. Documents without words, null texts among them, have size 0 and no pass; null is a source of its own, the
    last; equal rows are rows of their own. The order hangs on ids, checksums and the seed alone, so reruns agree.
    Columns named in ``carry`` come along; their names must not be those of the result.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    sizes = docs.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *carry,
    )
    sizes = materialize(sizes.withColumn("key", F.xxhash64(F.lit(seed), "id", "text_crc32")), "curriculum-sizes")
    targets = source_targets(sizes, weights, ramps, share, float(repeats))
    ordered = running_totals(sizes, ["source"], ["key", "id", "text_crc32"], ["size"], "curriculum-order")
    joined = ordered.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats))).otherwise(0)
    joined = joined.withColumn("whole", whole.cast("long"))
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    more = F.when(F.col("whole") >= repeats, F.lit(0)).otherwise(rest - F.col("size_before"))
    joined = joined.withColumn("part", F.greatest(F.least(more, F.col("size")), F.lit(0)).cast("long"))

    def reading(i: Column) -> Column:
        words = F.when(i < F.col("whole"), F.col("size")).when(i == F.col("whole"), F.col("part")).otherwise(F.lit(0))
        middle = i * F.col("source_size") + F.col("size_before") + words / 2
        position = due(middle / F.greatest(F.col("target"), F.lit(1.0)), F.col("start"), F.col("end"))
        return F.struct(i.cast("int").alias("pass"), words.cast("long").alias("words"), position.alias("position"))

    passes = F.filter(F.array(*[reading(F.lit(i)) for i in range(repeats)]), lambda p: p["words"] > 0)
    return joined.select(
        F.col("id").alias(id_column), F.col("source").alias(source_column), "size", "text_crc32", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), passes.alias("passes"), *carry,
    )


def in_order(plan: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """A curriculum whose ``passes`` also tell their place in the whole training: ``rank`` among all passes, ``start`` in words.

    All passes of all documents are range-sorted by position and added up by range; equal positions come in the order of
    ids, checksums and passes. Rows, not ids, are told apart.
    """
    stored = materialize(plan.withColumn("_row", F.monotonically_increasing_id()), "curriculum-rows")
    passes = stored.select("_row", F.col(id_column).alias("id"), "text_crc32", F.explode("passes").alias("p")).select("_row", "id", "text_crc32", "p.*")
    passes = materialize(passes, "curriculum-passes")
    order = ["position", "id", "text_crc32", "pass", "_row"]
    placed = running_totals(passes, [], order, ["words"], "curriculum-sorted")
    told = F.struct("pass", "words", "position", "rank", F.col("words_before").alias("start"))
    sorted_ = placed.groupBy("_row").agg(F.array_sort(F.collect_list(told)).alias("_passes"))
    joined = stored.join(sorted_, "_row", "left")
    empty = F.array().cast(sorted_.schema["_passes"].dataType)
    return joined.withColumn("passes", F.coalesce("_passes", empty)).drop("_passes", "_row")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row that tells null from absent: where a null stands counts too."""
    parts = []
    for i, field in enumerate(df.schema.fields):
        column = df[i]
        if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            column = F.to_json(F.struct(column.alias("v")))
        parts += [column, column.isNull()]
    return F.xxhash64(*parts)


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **options) -> DataFrame:
    """The documents as the curriculum reads them, in its order: one row a pass, with the columns of ``docs``.

    A cut document keeps its first words, joined by single spaces. Rows equal in all columns are one text that is read
    as often as all of them are; other rows of one id are rows of their own. Any further column may have any name. An
    empty table gives no rows.

    Texts are shuffled twice: to their passes, and to their place. The places are known from the plan (words before a
    pass, of all words), so the second shuffle samples nothing, and every partition gets the same number of words.
    """
    names = docs.columns
    spark = docs.sparkSession
    same = row_hash(docs)
    base = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{source_column}`").alias("source"), F.col(f"`{text_column}`").alias("text"), same.alias("same")
    )
    plan = curriculum(base, id_column="id", source_column="source", text_column="text", carry=("same",), **options)
    passes = plan.select("id", "text_crc32", "same", "size", F.explode("passes").alias("p")).select("id", "text_crc32", "same", "size", "p.*")
    passes = materialize(passes, "curriculum-passes")
    total = passes.agg(F.sum("words")).first()[0] or 0
    placed = running_totals(passes, [], ["position", "id", "text_crc32", "same", "pass"], ["words"], "curriculum-sorted")
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    to = F.least(F.floor(F.col("words_before") / F.lit(float(max(total, 1))) * wide), F.lit(wide - 1)).cast("int")
    placed = placed.select("same", F.col("text_crc32").alias("crc"), "size", "words", "rank", to.alias("to"))

    crc = F.crc32(F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary"))
    whole = F.struct(*[docs[i].alias(f"c{i}") for i in range(len(names))])
    rows = docs.select(same.alias("same"), crc.alias("crc"), whole.alias("doc")).groupBy("same", "crc").agg(F.any_value("doc").alias("doc"))
    read = placed.join(rows, ["same", "crc"])
    at = names.index(text_column)
    text = F.col(f"doc.c{at}")
    words = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    head = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")
    cut = F.when(F.col("words") == F.col("size"), text).otherwise(head)
    out = [(cut if i == at else F.col(f"doc.c{i}")).alias(f"c{i}") for i in range(len(names))]
    dealt = read.select(*out, "rank", "to").repartitionById(wide, "to")
    return dealt.sortWithinPartitions("rank").select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])
