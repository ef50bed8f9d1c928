"""Files that appear in a folder, each handled once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from refload.session import materialize
from refload.sources.profiles import WHOLE_FILE_BYTES, file_formats

# Fixed value: how often the folder is looked at.
SCAN_INTERVAL = "15 seconds"
BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arrivals(
    spark: SparkSession,
    folder: str,
    glob: str = "*.csv",
    files_per_batch: int = 1000,
    archive: str | None = None,
) -> DataFrame:
    """Stream of new files, of any size, without their bytes; finished ones move to ``archive`` if one is named.

    Spark's file sources list no file of zero bytes.
    """
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
    )
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).select("path", "modificationTime", "length")


def stream_dropfolder(
    spark: SparkSession,
    folder: str,
    registry: str,
    checkpoint: str,
    once: bool = False,
    glob: str = "*.csv",
    archive: str | None = None,
    whole_bytes: int = WHOLE_FILE_BYTES,
) -> StreamingQuery:
    """Profile every new file and add its format to the registry folder, one part a trigger.

    A trigger that is run again writes over its own part.
    """

    def profile(files: DataFrame, batch_id: int) -> None:
        found = file_formats(files.sparkSession, materialize(files, "arrivals"), whole_bytes)
        found.write.mode("overwrite").parquet(f"{registry}/trigger={batch_id}")

    writer = arrivals(spark, folder, glob, archive=archive).writeStream.foreachBatch(profile).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": SCAN_INTERVAL}
    return writer.trigger(**trigger).start()


def dedupe_arrivals(arrivals: DataFrame, path: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """First arrival of each file within the watermark; state older than that is dropped."""
    return arrivals.withWatermark(ts, delay).dropDuplicatesWithinWatermark([path])
