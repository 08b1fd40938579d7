"""Asset files as they arrive: the batch operators over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import assets

_FILES = "path string, modificationTime timestamp, length long, content binary"


def asset_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(asset, content, seen) of new files below a folder."""
    found = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return found.select(F.col("path").alias("asset"), "content", F.col("modificationTime").alias("seen"))


def roots(stream: DataFrame) -> DataFrame:
    """Format, size and root of each asset, or its error."""
    return assets.decoded(stream)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends decoded assets to a Parquet table; files are taken once, across restarts."""
    return roots(asset_stream(spark, folder)).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(out)
