"""Results of a stream written in parts of bounded size, at intervals, each once however often it is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexweave.sources import files


def flushed(results: DataFrame, folder: str, most: int, seconds: float | None = None) -> StreamingQuery:
    """Start writing a stream to folder/parts: a part a batch, of files of `most` rows at most, every so many seconds, or all there is at once.

    A part's name is its batch's number, and a batch that is tried again writes its part anew; so what a killed job left half done is
    replaced, and what it had done stays. State is in folder/state.
    """
    def write(part: DataFrame, number: int) -> None:
        # one action a batch: looking whether there are rows would count those looked at twice
        part.write.mode("overwrite").option("maxRecordsPerFile", most).parquet(f"{folder}/parts/batch={number}")

    started = results.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state")
    return (started.trigger(availableNow=True) if seconds is None else started.trigger(processingTime=f"{seconds} seconds")).start()


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all parts that were written whole, with batch long."""
    top = f"{folder}/parts"
    whole = [f"{top}/{n}" for n in files.names(spark, top) if n.startswith("batch=") and "_SUCCESS" in files.names(spark, f"{top}/{n}")]
    return spark.read.schema(schema + ", batch long").option("basePath", top).parquet(*whole) if whole else spark.createDataFrame([], schema + ", batch long")
