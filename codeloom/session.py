"""Session settings and the two facilities every iterative operator needs: a place for checkpoints and a size check
before anything is broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only if it has at most this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def build_session(cores: int | str = "*", memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session with the settings that a cluster should have too (AQE, skew joins, Arrow, UTC)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. One is made only where none is set and the session is local."""
    sc = spark.sparkContext
    if (now := sc.getCheckpointDir()) is not None:
        return now
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="codeloom-checkpoint-")
    sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage and plan: df is written as a table to the shared folder and read again, so a lost executor costs
    nothing and the plans of iterations do not add up in the driver. release() removes the table once it is superseded."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/codeloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def read_cuts(*frames: DataFrame) -> DataFrame:
    """The rows of several tables that cut() wrote, of one schema, as one scan: small files are read together, and the plan has
    one leaf whatever their number."""
    spark = frames[0].sparkSession
    return spark.read.schema(frames[0].schema).parquet(*[f._cut_path for f in frames])


def release(*frames: DataFrame) -> None:
    """Deletes tables that cut() wrote and nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as the session has cores. A table of a few small files would be worked on by
    as many tasks; one that already has enough partitions is left as it is, so nothing large is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows; reads no further than that."""
    return df.limit(limit + 1).count() <= limit
