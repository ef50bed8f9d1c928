"""One query per corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.llm.chat import PERSPECTIVES_SQL, perspectives
from refload.llm.curriculum import curriculum, in_order
from refload.llm.divergence import DIVERGENCE_SQL, source_divergence
from refload.llm.factorization import score_quality, train
from refload.llm.hard_negatives import HARD_NEGATIVES_SQL, hard_negatives
from refload.llm.hilbert import hilbert_shards
from refload.llm.html import extract_pages
from refload.llm.licenses import scan_licenses
from refload.llm.multi_index import near_vectors
from refload.llm.packing import pack
from refload.llm.perplexity import quality_rules
from refload.llm.rollup import corpus_rollup
from refload.llm.simhash import simhash_classes
from refload.session import new_folder

#: Folder of public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can say it."""

    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_simhash")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_classes(table(spark, sf, "documents"))


@query("op3_hilbert_shards")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    dealt = hilbert_shards(table(spark, sf, "documents"), ["source", "lang", "n_chars"], 16, "rows")
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


@query("op8_curriculum_mix")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    mixed = in_order(curriculum(table(spark, sf, "documents")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "passes")


@query("op10_multi_index")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))


@query("op2_mincut_text")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return extract_pages(table(spark, sf, "pages"))


@query("op5_ngram_perplexity")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules(table(spark, sf, "documents"))


@query("op6_factorization_machine")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return score_quality(docs, train(docs, table(spark, sf, "labels")))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"))


@query("op9_perspectives", PERSPECTIVES_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    made = perspectives(table(spark, sf, "conversations"))
    return made.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("mask_from", "mask_to")})


@query("op4_delta_rollup")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_rollup(table(spark, sf, "documents"), new_folder(spark, "rollup"), TOKENIZERS)


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence(table(spark, sf, "documents"))


@query("op12_hard_negatives", HARD_NEGATIVES_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


# Its SQL stands in ``licenses_sql`` and is held against it in the tests: nullable whole numbers are no single type to all readers.
@query("op13_license_scan")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents")).drop("places")
