"""Call traces: normal form, ingest, and edges with names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .upsert import merge_counters

EDGE = ["from_function_id", "to_function_id", "workload_id"]


def normalize(calls: DataFrame) -> DataFrame:
    """One row per edge and workload: counts added (a null or zero count is one), static_missed if any row has it."""
    n = F.coalesce(F.nullif("call_count", F.lit(0)), F.lit(1))
    return calls.groupBy(*EDGE).agg(F.sum(n).cast("bigint").alias("call_count"), F.bool_or(F.coalesce("static_missed", F.lit(False))).alias("static_missed"))


def ingest(calls: DataFrame) -> DataFrame:
    """One row per edge and workload as an ingest leaves it: counts added (null is one, zero stays), static_missed of the
    last row by time and id."""
    return merge_counters(calls, EDGE, F.coalesce("call_count", F.lit(1)), "static_missed", ["detected_at", "id"])


def with_names(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls with the names at both ends; calls to functions that are not there drop out. An id defined several times has
    its smallest name."""
    f = functions.where("id is not null").groupBy("id").agg(F.min("name").alias("name"))
    a = f.select(F.col("id").alias("from_function_id"), F.col("name").alias("caller"))
    b = f.select(F.col("id").alias("to_function_id"), F.col("name").alias("callee"))
    return calls.join(a, "from_function_id").join(b, "to_function_id")


def by_name(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Call counts between names; pre-aggregated by id so that the joins see edges, not events."""
    e = calls.groupBy("from_function_id", "to_function_id").agg(F.sum(F.coalesce("call_count", F.lit(1))).cast("bigint").alias("n"))
    return with_names(e, functions).groupBy("caller", "callee").agg(F.sum("n").cast("bigint").alias("calls"))
