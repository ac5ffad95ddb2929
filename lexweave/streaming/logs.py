"""Request events as streams: JSON lines in, windows and session counts out, late and repeated events bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "id string, ts timestamp, provider string, model string, status_code int, outcome string, elapsed_ms long, token_total long, error string, category string"


def tail(spark: SparkSession, path: str) -> DataFrame:
    """New events of a folder of JSON lines."""
    return spark.readStream.schema(EVENT).json(path)


def deduplicated(events: DataFrame, ts: str = "ts", key: str = "id", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def outcome_counts(events: DataFrame, kind: str, ts: str = "ts", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) of tumbling windows; events may be batch or stream."""
    own = events.withWatermark(ts, late) if events.isStreaming else events
    return own.groupBy(F.window(ts, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of runs of events less than a gap apart."""
    own = events.withWatermark(ts, late) if events.isStreaming else events
    return own.groupBy(F.col(key).alias("key"), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
