"""Access to the Parquet tables, with the adapters that clean what every operator would have to clean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small, spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_once(spark: SparkSession, folder: str, name: str = "code_inputs") -> DataFrame:
    """path, content: one row per path, of exact copies the first by its place in the files, of different texts the greatest (a
    null one is the least). Null paths are left out.

    The texts themselves are not moved, but for those of paths with different ones: the places of surplus rows are found by
    paths and hashes alone, and those rows are dropped where they are read. A list of more places than BROADCAST_ROWS is
    not sent to all; then the rows are joined.
    """
    src = table(spark, folder, name).where("path is not null").select("path", "content", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    at = F.struct("_file", "_row")
    twice = src.groupBy("path").agg(F.min(at).alias("kept"), F.count("*").alias("n")).where("n > 1").select("path", "kept")
    text = F.xxhash64("content")
    differ = src.groupBy("path").agg(F.min(text).alias("least"), F.max(text).alias("most")).where("least <> most").select("path")
    if not differ.isEmpty():
        some = src.join(F.broadcast(differ) if small(differ) else differ, "path").groupBy("path").agg(F.max(F.struct("content", "_file", "_row")).alias("best"))
        twice = twice.join(differ, "path", "left_anti").unionByName(some.select("path", F.struct("best._file", "best._row").alias("kept")))
    surplus = src.select("path", "_file", "_row").join(twice, "path").where(at != F.col("kept")).select("_file", "_row")
    surplus = F.broadcast(surplus) if small(surplus) else surplus
    kept = spread(src).join(surplus, ["_file", "_row"], "left_anti")
    # Conditions on texts do not pass a generator: else they would be tried before the rows are spread, where a table of one
    # file is read by one task.
    return kept.select(F.explode(F.array(F.struct("path", "content"))).alias("r")).select("r.path", "r.content")


def current_files(files: DataFrame, *columns: str) -> DataFrame:
    """One row per file id: that with the latest last_scanned (a null one counts as oldest).

    max_by over a struct needs one shuffle of pre-aggregated rows and no sort; only the columns asked for travel.
    Two versions of the same instant: the row with the greater (hash, size) is kept.
    """
    cols = [c for c in dict.fromkeys(columns) if c != "id"]
    keep = F.struct(*[F.col(c) for c in cols]) if cols else F.struct(F.lit(1).alias("one"))
    order = F.struct(F.coalesce(F.col("last_scanned"), F.lit("0001-01-01").cast("timestamp_ntz")), F.col("hash"), F.col("size_bytes"))
    out = files.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(keep, order).alias("_row"))
    return out.select("id", *[F.col(f"_row.{c}").alias(c) for c in cols])
