"""Measures of extraction runs: a table of runs that is appended to, and its averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run long, seconds double, n_entities long, confidence double, failed boolean"


def new_log(spark: SparkSession) -> DataFrame:
    """A log without runs; also what a reset leaves."""
    return spark.createDataFrame([], SCHEMA)


def record_extractions(log: DataFrame, timings: DataFrame, entities: DataFrame) -> DataFrame:
    """log with a run for each row of timings (run, seconds); entities: run, confidence. A run without entities has no confidence."""
    found = entities.groupBy("run").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    rows = timings.join(found, "run", "left")
    return log.unionByName(rows.select("run", "seconds", F.coalesce("n", F.lit(0).cast("long")).alias("n_entities"), "confidence", F.lit(False).alias("failed")))


def record_errors(log: DataFrame, runs: DataFrame) -> DataFrame:
    """log with a failed run for each row of runs (run)."""
    none = lambda kind: F.lit(None).cast(kind)
    return log.unionByName(runs.select("run", none("double").alias("seconds"), none("long").alias("n_entities"), none("double").alias("confidence"), F.lit(True).alias("failed")))


def metrics(log: DataFrame) -> DataFrame:
    """Mean seconds, confidence and entities of the runs that ended, and the failed ones' share of ended (one at least) and failed ones."""
    ended, failed = F.count_if(~F.col("failed")), F.count_if(F.col("failed"))
    mean = lambda c: F.round(F.avg(c), 6)
    return log.agg(mean("seconds").alias("mean_seconds"), mean("confidence").alias("mean_confidence"), mean("n_entities").alias("mean_entities"), F.round(failed / (F.greatest(F.lit(1), ended) + failed), 6).alias("error_rate"))
