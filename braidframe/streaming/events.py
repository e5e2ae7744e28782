"""Event streams: the same window operators on tables and on streams (extensions to the reference)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_parquet(spark: SparkSession, folder: str, like: DataFrame, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream with a known schema."""
    reader = spark.readStream.schema(like.schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need; the session's zone is to be UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(df: DataFrame, ts: str, size: str, *keys: str, slide: str | None = None, value: str | None = None, late: str | None = None) -> DataFrame:
    """(window_start, keys, n, total): tumbling, or sliding with ``slide``; a watermark where ``late`` is given."""
    d = event_time(df, ts)
    if late:
        d = d.withWatermark(ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.sum(value).alias("total"))
    out = d.groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", *(["total"] if value else []))


def session_counts(df: DataFrame, ts: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    """(session_start, session_end, keys, n): activity without a pause of ``gap``; the end includes the gap."""
    d = event_time(df, ts)
    if late:
        d = d.withWatermark(ts, late)
    out = d.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def first_seen(df: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """Distinct by ``keys`` within the watermark: repeats that arrive while it is open are dropped."""
    return event_time(df, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there and end; ``sink`` gets each micro-batch with its number.

    A batch number can come twice after a failure, so the sink has to be idempotent by it.
    """
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """The same into a Parquet folder, exactly once (append mode)."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
