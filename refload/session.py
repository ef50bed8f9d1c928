"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(master: str = "local[8]", app: str = "refload", **extra: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="refload-warehouse-"),
        **extra,
    }
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only where none is named and everything runs on one machine (tests) is a folder made here; on a cluster, where
    each executor would write to its own disk, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="refload-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return os.path.join(shared_folder(spark), f"refload-{label}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a table that outlives a lost executor, and pins columns whose value depends
    on the scan layout (record positions) so that several readers see the same ones.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


ARROW_TYPES = {
    "string": pa.string(),
    "integer": pa.int32(),
    "long": pa.int64(),
    "boolean": pa.bool_(),
    "timestamp_ntz": pa.timestamp("us"),
    "timestamp": pa.timestamp("us", tz="UTC"),
    "double": pa.float64(),
}


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A handful of rows known to the driver (names, schemas, settings) as a local relation: no job, no worker."""
    fields = T.StructType.fromDDL(schema).fields
    columns = [pa.array([r[i] for r in rows], ARROW_TYPES[f.dataType.typeName()]) for i, f in enumerate(fields)]
    given = spark.createDataFrame(pa.table(columns, names=[f.name for f in fields]))
    return given.select(*[given[f.name].cast(f.dataType) for f in fields])
