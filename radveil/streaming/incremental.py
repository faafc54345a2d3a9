"""Incremental runs with Structured Streaming: new source files are parsed once, copies are dropped across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import layout
from ..schemas import SOURCE_FILES


def source_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of extracted files from a folder of Parquet files."""
    return spark.readStream.schema(SOURCE_FILES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def parsed_stream(files: DataFrame, key: K.LinkKey = K.PUBLIC_TEST_KEY, event_time: str | None = None, late: str = "30 days") -> DataFrame:
    """uid and parsed report of every new content. With ``event_time`` the state of seen contents is bounded by the watermark."""
    rows = files.withColumn("uid", K.keyed_hash(F.col("sha256"), "file", key, 20))
    if event_time:
        rows = rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["uid"])
    else:
        rows = rows.dropDuplicates(["uid"])
    return rows.withColumn("parsed", layout.parsed(F.col("text"), F.col("error"))).select("uid", "file_index", "parsed.*")


def append_to(stream: DataFrame, out: str, checkpoint: str):
    """Start appending to a Parquet folder; each batch is written once."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
