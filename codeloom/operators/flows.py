"""Data flows between named resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resources(events: DataFrame) -> DataFrame:
    """Distinct resources of flow events (source, target, kind): id, qualified_name. The id is a hash of the name, so it
    is the same wherever and whenever it is made."""
    n = events.select(F.col("source").alias("qualified_name")).unionByName(events.select(F.col("target").alias("qualified_name"))).where("qualified_name is not null").distinct()
    return n.select(F.xxhash64("qualified_name").alias("id"), "qualified_name")


def data_flows(events: DataFrame, functions: DataFrame) -> DataFrame:
    """Flow events with both resources, and the functions at their ends where such a name is defined (smallest id)."""
    f = functions.where("name is not null").groupBy("name").agg(F.min("id").alias("fid"))
    j = events.join(f.select(F.col("name").alias("source"), F.col("fid").alias("source_function_id")), "source", "left")
    return j.join(f.select(F.col("name").alias("target"), F.col("fid").alias("target_function_id")), "target", "left")


def resource_flows(events: DataFrame) -> DataFrame:
    """Both directions of each flow seen from its ends: resource, direction, other, flows."""
    out = events.select(F.col("source").alias("resource"), F.lit("out").alias("direction"), F.col("target").alias("other"))
    into = events.select(F.col("target").alias("resource"), F.lit("in").alias("direction"), F.col("source").alias("other"))
    return out.unionByName(into).groupBy("resource", "direction", "other").agg(F.count("*").alias("flows"))
