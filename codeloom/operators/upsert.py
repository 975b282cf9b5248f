"""Writes re-expressed as results: the table after the write, from the table before and the rows that come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: that of the greatest order. Order must decide ties (give a unique column last).

    An aggregation instead of a window: rows are reduced before the shuffle, so a hot key costs one row a task.
    """
    rest = [c for c in rows.columns if c not in keys]
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table with incoming rows put in; of equal keys the incoming one stays, of several incoming the last."""
    both = table.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return last_write_wins(both, keys, ["_new", *order]).drop("_new")


def merge_counters(rows: DataFrame, keys: list[str], count: Column, flag: str, order: list[str]) -> DataFrame:
    """Counters by key: counts are added up, the flag is that of the last row."""
    return rows.groupBy(*keys).agg(F.sum(count).cast("bigint").alias("call_count"), F.max_by(flag, F.struct(*order)).alias(flag), F.count("*").alias("rows"))


def expire(rows: DataFrame, until: str, now: Column) -> DataFrame:
    """Rows that have no end or one after now; an end at now itself has expired."""
    return rows.where(F.col(until).isNull() | (F.col(until) > now))


def delete(rows: DataFrame, condition: Column) -> DataFrame:
    """The rows left after a delete; where the condition is null nothing is deleted."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def overwrite(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Writes the table as Parquet; of a partitioned one only the partitions that have rows are replaced."""
    w = df.write.mode("overwrite")
    if partition:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    w.parquet(path)
