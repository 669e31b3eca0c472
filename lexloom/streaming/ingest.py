"""Incremental ingest: the batch operators over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lexloom.sources.jsonl import select


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """(file, raw) of the lines of new files; whole files, so a file must be complete when it appears."""
    read = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("source_bytes"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, language: str) -> StreamingQuery:
    """Validates and selects all lines that have arrived, then stops; a restart goes on where the last run ended.

    Lines have no numbers in a stream: their identity is their digest, and batches write it with
    the record. A line that arrives again is kept once per batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        bare = F.when(F.substring(F.col("source_bytes"), -1, 1) == F.lit(b"\r"), F.expr("substring(source_bytes, 1, octet_length(source_bytes) - 1)")).otherwise(F.col("source_bytes"))
        lines = batch.select(F.lit(0).cast("long").alias("line_number"), F.lit(0).cast("long").alias("byte_offset"), bare.alias("source_bytes")).dropDuplicates(["source_bytes"])
        made = select(lines, language).drop("line_number", "byte_offset").withColumn("record_sha256", F.sha2("source_bytes", 256))
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream_lines(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_deliveries(stream: DataFrame, time: str, late: str = "30 days") -> DataFrame:
    """(day, n_rows) of rows by event day; rows later than ``late`` behind the newest are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.col("w.start").alias("day"), "n_rows")
