"""Debt items: id, type, severity, resolved, detected_at, file_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("high", "medium", "low")


def weight(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def breakdown(items: DataFrame, types: list[str]) -> DataFrame:
    """dimension, value, n of unresolved items: total, each severity and each type, in one pass; keys without items are 0."""
    open_items = items.where(~F.coalesce("resolved", F.lit(False)))
    g = open_items.groupingSets([["severity"], ["type"], []], "severity", "type").agg(F.count("*").alias("n"), F.grouping_id("severity", "type").alias("g"))
    got = g.select(F.when(F.col("g") == 1, "severity").when(F.col("g") == 2, "type").otherwise("total").alias("dimension"), F.when(F.col("g") == 1, F.col("severity")).when(F.col("g") == 2, F.col("type")).otherwise("all").alias("value"), "n")
    keys = [("total", "all"), *[("severity", s) for s in SEVERITIES], *[("type", t) for t in types]]
    dim = items.sparkSession.createDataFrame(keys, "dimension string, value string")
    return dim.join(got, ["dimension", "value"], "left").select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n"))


def severities(items: DataFrame) -> DataFrame:
    """One row: open items of each severity."""
    open_items = ~F.coalesce("resolved", F.lit(False))
    return items.agg(*[F.count_if(open_items & (F.col("severity") == s)).alias(s) for s in SEVERITIES])


def page(items: DataFrame, limit: int = 100, offset: int = 0, severity: str | None = None, kind: str | None = None, resolved: bool = False) -> DataFrame:
    """A page of items, newest first; limit 0 stands for all."""
    x = items if resolved else items.where(~F.coalesce("resolved", F.lit(False)))
    if severity:
        x = x.where(F.col("severity") == severity)
    if kind:
        x = x.where(F.col("type") == kind)
    x = x.orderBy(F.desc("detected_at"), "id").offset(offset)
    return x.limit(limit) if limit else x


def page_with_more(items: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """A page with has_more: whether there are items beyond it, which the one row more that is read says."""
    if not limit:
        return page(items, 0, offset, **filters).withColumn("has_more", F.lit(False))
    rows = page(items, limit + 1, offset, **filters).withColumn("_n", F.row_number().over(Window.orderBy(F.desc("detected_at"), "id")))
    return rows.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def prioritized(items: DataFrame, n: int = 50) -> DataFrame:
    return items.where(~F.coalesce("resolved", F.lit(False))).withColumn("weight", weight(F.col("severity"))).orderBy(F.desc("weight"), F.desc("detected_at"), "id").limit(n)


def cleanup(items: DataFrame, as_of: Column, days: int) -> DataFrame:
    """What a cleaning leaves: resolved items of that age go by their end, unresolved low ones by their start."""
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    old = (F.col("resolved") & (F.coalesce("resolved_at", "detected_at") < cutoff)) | (~F.col("resolved") & (F.col("severity") == "low") & (F.col("detected_at") < cutoff))
    return items.where(~F.coalesce(old, F.lit(False)))


def resolve(items: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Items of ids (column id) set resolved at now."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return items.join(hit, "id", "left").withColumn("resolved", F.coalesce("_hit", "resolved")).withColumn("resolved_at", F.when(F.col("_hit"), now).otherwise(F.col("resolved_at"))).drop("_hit")


def refactor_roi(files: DataFrame, complex_functions: DataFrame, frequency: DataFrame) -> DataFrame:
    """Candidates for refactoring with their return: risk reduction times frequency by effort.

    files: id, relative_path, size_bytes, cognitive_load; complex_functions: file_id, worst (complexity); frequency:
    file_id, churn. Candidates: high load, functions of complexity over 10, large files.
    """
    f = files.join(frequency.withColumnRenamed("file_id", "id"), "id", "left").join(complex_functions.withColumnRenamed("file_id", "id"), "id", "left").withColumn("churn", F.coalesce("churn", F.lit(0))).withColumn("effort", F.greatest(F.ceil(F.coalesce("size_bytes", F.lit(0)) / 50 / 100), F.lit(1)).cast("bigint"))
    load = f.where("cognitive_load > 0.2").select("id", F.lit("load").alias("reason"), F.col("cognitive_load").alias("reduction"), "churn", "effort")
    cc = f.where("worst > 10").select("id", F.lit("complexity").alias("reason"), F.least(F.col("worst") / 20.0, F.lit(1.0)).alias("reduction"), "churn", "effort")
    big = f.where("size_bytes > 5000").select("id", F.lit("size").alias("reason"), F.lit(0.5).alias("reduction"), "churn", "effort")
    u = load.unionByName(cc).unionByName(big)
    roi = F.round(F.col("reduction") * (F.col("churn") + 1) / F.col("effort"), 2)
    return u.select("id", "reason", "effort", roi.alias("roi")).withColumn("priority", F.when(F.col("roi") > 3, "critical").when(F.col("roi") > 1.5, "high").when(F.col("roi") > 0.8, "medium").otherwise("low"))
