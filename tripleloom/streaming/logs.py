"""Append-only logs as streams: the last record of each key, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, path: str, schema: str, fmt: str = "json", per_trigger: int = 100) -> DataFrame:
    """A folder of appended files as a stream."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def latest_stream(log: DataFrame, key: str, sequence: str, value: str) -> DataFrame:
    """(key, value, sequence): the last value of each key; state is one row for each key."""
    kept = log.where(F.col(key).isNotNull()).groupBy(key)
    return kept.agg(F.max_by(value, sequence).alias(value), F.max(sequence).alias(sequence))


def counts_by_window(log: DataFrame, at: str, kind: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, kind, n): records by event time; later ones than the watermark are dropped and their state freed."""
    return log.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count("*").alias("n"))


def run_to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Runs the stream over what is there now into a table in memory; for tests and small views."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
