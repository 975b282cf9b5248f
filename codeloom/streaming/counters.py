"""Streams: counters of calls, windows, expiry and incremental files. The results of a stream that has ended equal the
batch operators on the same rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events_stream(spark: SparkSession, folder: str, schema: str = EVENTS, per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream, per_trigger of them at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def call_counter(events: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Running totals by key; a null count is one. State is one row a key."""
    return events.groupBy(*keys).agg(F.sum(F.coalesce(F.col(count), F.lit(1))).alias("total"), F.count("*").alias("rows"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by kind in tumbling windows; what comes later than the watermark is dropped and its state freed."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", size, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "24 hours", late: str = "2 days") -> DataFrame:
    """Sessions of each user: events no further apart than gap."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def session_intervals(events: DataFrame, gap: str = "24 hours", late: str = "2 days") -> DataFrame:
    """Sessions of each user with their first and last event."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = e.groupBy(F.session_window("at", gap), "user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("n"))
    return g.select("user_id", "started_at", "ended_at", "n")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each key once within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def enrich(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """A stream joined with a table that stands still."""
    return events.join(static, key, "left")


def run_once(stream: DataFrame, mode: str, path: str, checkpoint: str | None = None) -> None:
    """Runs a stream over all that is there and ends. Each batch writes its own folder (batch=N), so that a batch that is
    run again after a failure overwrites itself."""
    where = checkpoint or f"{checkpoint_dir(stream.sparkSession)}/stream-{hashlib.sha256(path.encode()).hexdigest()[:32]}"

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()


def latest_of(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of each key of a stream that run_once wrote in update mode."""
    rows = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
