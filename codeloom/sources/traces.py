"""Recorded call events: JSON files of an array, of `calls` or of `events`, and lines of JSON among other output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "struct<fromFunctionName string, toFunctionName string, workloadId string, callCount bigint, staticMissed boolean, type string>".replace(" string", ":string").replace(" bigint", ":bigint").replace(" boolean", ":boolean")


def _columns(df: DataFrame, e: str) -> DataFrame:
    return df.select(F.col(f"{e}.fromFunctionName").alias("from_function"), F.col(f"{e}.toFunctionName").alias("to_function"), F.col(f"{e}.workloadId").alias("workload_id"), F.col(f"{e}.callCount").alias("call_count"), F.col(f"{e}.staticMissed").alias("static_missed"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """from_function, to_function, workload_id, call_count, static_missed of trace files. Files that are no JSON of a
    known form have no events."""
    t = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", f"struct<calls:array<{EVENT}>,events:array<{EVENT}>>")
    array = F.from_json("value", f"array<{EVENT}>")
    listed = F.when(F.ltrim("value").startswith("["), array).otherwise(F.coalesce(whole["calls"], whole["events"]))
    return _columns(t.select(F.explode(listed).alias("e")), "e").where("from_function is not null and to_function is not null")


def from_lines(df: DataFrame) -> DataFrame:
    """Events among lines of output (column value): lines that begin with a brace and are of type trace or name a caller."""
    e = df.where(F.ltrim("value").startswith("{")).select(F.from_json("value", EVENT).alias("e"))
    return _columns(e.where((F.col("e.type") == "trace") | F.col("e.fromFunctionName").isNotNull()), "e").where("from_function is not null and to_function is not null")


def normalize(events: DataFrame) -> DataFrame:
    """One row per edge and workload: counts added (null or zero is one), static_missed if any event says so."""
    n = F.when(F.coalesce("call_count", F.lit(0)) == 0, 1).otherwise(F.col("call_count"))
    return events.groupBy("from_function", "to_function", "workload_id").agg(F.sum(n).cast("bigint").alias("call_count"), F.bool_or(F.coalesce("static_missed", F.lit(False))).alias("static_missed"))
