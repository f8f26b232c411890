"""Streaming twins of the log aggregates: the same results from files as they arrive, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100, glob: str | None = None) -> DataFrame:
    """A stream of parquet files of a folder with a stated schema."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def timed(events: DataFrame, at: str) -> DataFrame:
    """The event time as a timestamp of the session's zone, which watermarks need; logs may have one without a zone."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def windowed_kinds(events: DataFrame, at: str, kind: str, timing: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, kind, n, mean_timing of tumbling windows; a window is final once the watermark has passed it."""
    rows = timed(events, at).withWatermark(at, late).groupBy(F.window(at, size).alias("w"), F.col(kind).alias("kind"))
    found = rows.agg(F.count("*").alias("n"), F.sum(F.col(timing).cast("decimal(18,4)")).alias("t"), F.count(timing).alias("timed"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "kind", "n", F.round(F.try_divide(F.col("t").cast("double"), F.col("timed").cast("double")), 9).alias("mean_timing"))


def sessions(events: DataFrame, at: str, entity: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """entity, start, stop, n of runs of rows with pauses shorter than `gap`."""
    rows = timed(events, at).withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), F.col(entity))
    return rows.agg(F.count("*").alias("n")).select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def without_repeats(events: DataFrame, at: str, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: state is dropped as it passes, so it does not grow with the stream."""
    return timed(events, at).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into parquet under folder/out, and returns it; a restart goes on where it ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
