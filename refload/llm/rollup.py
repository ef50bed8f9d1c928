"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch brings documents in (again) with their counts, or takes them away. What it changes is written as signed rows:
the old count of a document with a minus, the new one with a plus, each under the source and language it belongs to. Sums
of these rows are the totals; nothing is ever counted anew. A batch counts from the moment its name is in the list of
commits, and a name is taken once: running it again, whole or after a failure, changes nothing.

Ledger rows lie in buckets of their id, so a batch reads only the buckets it touches, and of these only its own ids go on.
``compact`` puts all batches so far into one, as a commit of its own. A rollup has one writer at a time.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.llm.common import map_batches, running_totals, utf8
from refload.session import materialize

KEYS = ("source", "lang", "version")
COMMIT = "batch string, covers array<string>"


class TokenRollup:
    """Ledger (document rows), deltas (sums of a batch) and commits under one folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        """``buckets`` counts when the folder is new; it stays with the folder."""
        self.spark, self.root = spark, root
        spark.createDataFrame([], COMMIT).write.mode("ignore").parquet(f"{root}/commits")
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("ignore").parquet(f"{root}/layout")
        self.buckets = spark.read.parquet(f"{root}/layout").first()["buckets"]

    def _commits(self) -> list:
        return self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits").distinct().collect()

    def batches(self) -> list[str]:
        """Names of the batches that count."""
        return sorted(r.batch for r in self._commits() if r.covers is None)

    def _committed(self, what: str) -> DataFrame | None:
        """Rows of all that counts: batches, or the compacted ones that cover them."""
        commits = self._commits()
        covered = {name for r in commits for name in r.covers or ()}
        paths = sorted(f"{self.root}/{what}/batch={r.batch}" for r in commits if r.batch not in covered)
        if not paths:
            return None
        # The folders of a batch without changes hold no file, so columns are those noted at the first commit.
        columns = self.spark.read.parquet(f"{self.root}/columns/{what}").schema
        return self.spark.read.schema(columns).option("basePath", f"{self.root}/{what}").parquet(*paths)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("id", "version"), F.lit(self.buckets)).cast("int"))

    def current(self, of: DataFrame | None = None) -> DataFrame | None:
        """(id, version, source, lang, tokens) of every document that is in now, or of those with the ids, versions and buckets of ``of``."""
        parts = self._committed("ledger")
        if parts is None:
            return None
        if of is not None:
            touched = [r.bucket for r in of.select("bucket").distinct().collect()]
            wanted = of.select(F.col("id").alias("_id"), F.col("version").alias("_version"))
            same = F.col("id").eqNullSafe(F.col("_id")) & F.col("version").eqNullSafe(F.col("_version"))
            parts = parts.where(F.col("bucket").isin(touched)).join(wanted, same, "left_semi")
        sums = parts.groupBy("id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs > 0").select("id", "version", "source", "lang", "tokens")

    def _write(self, name: str, signed: DataFrame) -> None:
        """Ledger rows (id, version, source, lang, docs, tokens) and their sums; nothing of it counts before ``name`` is listed."""
        rows = self._bucketed(signed)
        rows.limit(0).write.mode("ignore").parquet(f"{self.root}/columns/ledger")
        path = f"{self.root}/ledger/batch={name}"
        rows.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        rows = self.spark.read.schema(rows.schema).parquet(path)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.limit(0).write.mode("ignore").parquet(f"{self.root}/columns/deltas")
        sums.write.mode("overwrite").parquet(f"{self.root}/deltas/batch={name}")

    def compact(self) -> bool:
        """Put all that counts into one set of files; False if there is nothing to put together. Totals and known names stay.

        The rows that take the place of others count from the one commit that names those, so a lost job changes nothing.
        """
        commits = self._commits()
        covered = {name for r in commits for name in r.covers or ()}
        live = sorted(r.batch for r in commits if r.batch not in covered)
        if len(live) < 2:
            return False
        name = f"compacted.{len(commits)}"
        state = self.current()
        self._write(name, state.select("id", "version", "source", "lang", F.lit(1).cast("long").alias("docs"), "tokens"))
        made = F.array(*[F.lit(x) for x in live]).alias("covers")
        self.spark.range(1).select(F.lit(name).alias("batch"), made).write.mode("append").parquet(f"{self.root}/commits")
        return True

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply ``events`` (id, source, lang, version, tokens, deleted) once; False if the batch is in already.

        One id has one state a version. Of several events for it the last by (deleted, tokens, source, lang) holds.
        A delete of what is not there, and a revision to the same values, change nothing. Null ids, sources and
        languages are values of their own; null counts are 0. A batch that failed before its name was listed is
        written over.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"bad batch name {batch!r}")
        if batch in self.batches():
            return False
        state = F.struct("deleted", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "source", "lang")
        last = events.groupBy("id", "version").agg(F.max(state).alias("new"))
        last = materialize(self._bucketed(last), "rollup-events")
        before = self.current(last)
        if before is None:
            joined = last.withColumn("old", F.lit(None).cast("struct<tokens: long, source: string, lang: string>"))
        else:
            old = before.select(F.col("id").alias("_id"), F.col("version").alias("_version"), F.struct("tokens", "source", "lang").alias("old"))
            same = F.col("id").eqNullSafe(F.col("_id")) & F.col("version").eqNullSafe(F.col("_version"))
            joined = last.join(old, same, "left").select("id", "version", "new", "old")
        comes = ~F.col("new.deleted")
        equal = comes & F.col("new.tokens").eqNullSafe(F.col("old.tokens"))
        for key in ("source", "lang"):
            equal = equal & F.col(f"new.{key}").eqNullSafe(F.col(f"old.{key}"))
        equal = equal & F.col("old").isNotNull()
        minus = F.struct(
            F.col("old.source").alias("source"), F.col("old.lang").alias("lang"), F.lit(-1).cast("long").alias("docs"),
            (-F.col("old.tokens")).alias("tokens"),
        )
        plus = F.struct(
            F.col("new.source").alias("source"), F.col("new.lang").alias("lang"), F.lit(1).cast("long").alias("docs"),
            F.col("new.tokens").alias("tokens"),
        )
        both = F.array(F.when(F.col("old").isNotNull(), minus), F.when(comes, plus))
        signed = joined.filter(~equal).select("id", "version", F.explode(both).alias("s")).filter("s IS NOT NULL")
        self._write(batch, signed.select("id", "version", "s.*"))
        done = F.lit(batch).alias("batch"), F.lit(None).cast("array<string>").alias("covers")
        self.spark.range(1).select(*done).write.mode("append").parquet(f"{self.root}/commits")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) of all that is in, from the batches' deltas."""
        deltas = self._committed("deltas")
        if deltas is None:
            return self.spark.createDataFrame([], "source string, lang string, version string, docs long, tokens long")
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 OR tokens <> 0").select(*KEYS, "docs", "tokens")


def byte_pair_counter(folder: str, name: str = "byte_bpe_50k.tiktoken") -> tuple[str, Callable[[], Callable[[str], int]]]:
    """(version, maker of a counter) from a file of ranks; the file is read here and travels with the tasks."""
    with open(os.path.join(folder, name), "rb") as file:
        ranks = file.read()
    import public_tokenizers  # holds the pattern that these vocabularies cut texts by

    pattern = public_tokenizers.PATTERN

    def make() -> Callable[[str], int]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        coder = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})
        return lambda text: len(coder.encode_ordinary(text))

    return name.rsplit(".", 1)[0], make


def token_counts(docs: DataFrame, make: Callable[[], Callable[[str], int]], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, tokens) of every row; null texts have none."""
    holder: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not holder:
            holder.append(make())
        count = holder[0]
        made = [count(t.decode("utf-8", "replace")) if t else 0 for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.int64())], names=["id", "tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")), run, f"id {kind}, tokens long")


def corpus_rollup(
    docs: DataFrame, root: str, tokenizers: str, id_column: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text"
) -> DataFrame:
    """Totals of a corpus by words and by a byte-pair tokenizer, in four batches.

    "arrived" brings all documents in, by their words and by a guess of their tokens (a quarter of the bytes).
    "counted" revises the guess to the tokenizer's count. "copies" takes out every document whose text another of
    smaller id has. "counted" comes once more, as after a lost answer, and is known.

    A document is a row: its id, its text's hashes, and its number among the rows that share them. So rows with a null
    id and several texts under one id all count. A row that repeats id and text is a copy too; null ids are no copies.
    """
    spark = docs.sparkSession
    version, make = byte_pair_counter(tokenizers)
    body = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(
        F.col(id_column).alias("id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"),
        F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.octet_length(body).alias("bytes"),
        F.xxhash64(body).alias("print"), F.crc32(body.cast("binary")).alias("check"), F.col(text).alias("body"),
    )
    packed = facts.select(F.struct("id", "source", "lang", "words", "bytes", "print", "check").alias("id"), "body")
    facts = materialize(token_counts(packed, make, "id", "body").select("id.*", "tokens"), "rollup-facts")
    # Rows that are equal in source and language too are told apart by nothing, so any of them may have any number.
    facts = running_totals(facts, ["id", "print", "check"], ["source", "lang"], [], "rollup-numbered")
    facts = materialize(facts.withColumn("row", F.struct("id", "print", "check", "rank")), "rollup-rows")
    kinds = F.explode(
        F.array(
            F.struct(F.lit("words").alias("version"), F.col("words").alias("tokens")),
            F.struct(F.lit(version).alias("version"), F.ceil(F.col("bytes") / 4).cast("long").alias("tokens")),
        )
    )
    arrived = facts.select("row", "source", "lang", kinds.alias("k")).select(F.col("row").alias("id"), "source", "lang", "k.*")
    arrived = arrived.withColumn("deleted", F.lit(False))
    counted = facts.select(F.col("row").alias("id"), "source", "lang", F.lit(version).alias("version"), "tokens", F.lit(False).alias("deleted"))
    first = materialize(facts.groupBy("print", "check").agg(F.min("id").alias("first")), "rollup-first")
    same = (F.col("id.print") == F.col("print")) & (F.col("id.check") == F.col("check"))
    copies = arrived.join(first, same).filter("id.id > first OR (id.id IS NOT NULL AND id.rank > 0)").drop("print", "check", "first").withColumn("deleted", F.lit(True))
    rollup = TokenRollup(spark, root)
    for name, events in (("arrived", arrived), ("counted", counted), ("copies", copies), ("counted", counted)):
        rollup.commit(name, events)
    return rollup.totals()
