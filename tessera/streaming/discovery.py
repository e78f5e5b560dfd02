"""Incremental discovery: new slide files as a stream, appended to a listing table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.paths import backend_of, is_supported, stem_of

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_slides(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(slide_id, path, stem, backend, length) of supported files as they appear; contents are pruned."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", str(recursive).lower()).load(path)
    rows = files.where(is_supported(F.col("path")))
    return rows.select(F.xxhash64("path").alias("slide_id"), "path", stem_of(F.col("path")).alias("stem"), backend_of(F.col("path")).alias("backend"), "length")


def append_new_slides(spark: SparkSession, path: str, listing: str, checkpoint: str) -> StreamingQuery:
    """Takes all files that no earlier call has listed, appends them to ``listing`` exactly once, and ends."""
    out = stream_slides(spark, path).writeStream.format("parquet").option("path", listing).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(availableNow=True).start()
