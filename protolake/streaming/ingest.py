"""Optional extension: files as a stream, job states, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolake.operators.extract import sections
from protolake.refdata import JOB_PROGRESS


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """Each new text file as a row: path, text."""
    return spark.readStream.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def ingest_sections(stream: DataFrame, out: str, checkpoint: str):
    """Writes the sections of every batch of new files; replays of a batch overwrite its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        docs = batch.select(F.xxhash64("path").alias("doc_id"), "text")
        sections(docs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(updates: DataFrame) -> DataFrame:
    """updates: job_id, ts, state; the latest state of each job with its progress."""
    last = updates.groupBy("job_id").agg(F.max(F.struct("ts", "state")).alias("x"))
    progress = F.lit(0)
    for k, v in JOB_PROGRESS.items():
        progress = F.when(F.col("x.state") == k, v).otherwise(progress)
    return last.select("job_id", "x.ts", "x.state", progress.alias("progress"))


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling windows; the watermark bounds the state of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
