"""Searches for similar vectors: a stated set of queries against all rows, in blocks.

Blocks of queries (at most BLOCK of them, so the broadcast is bounded) pass over the rows where they lie; each batch is
one matrix product and keeps, per query, what can still be among the best. Only those few rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Queries that are sent to the workers at once.
BLOCK = 4096


def nearest(queries: DataFrame, rows: DataFrame, id_column: str, vector: str, k: int = 10, threshold: float = 0.7, strict: bool = False) -> DataFrame:
    """id, neighbour, score (rounded to six decimals): the k best other rows for each query with a score of at least
    (strict: above) the threshold, ties to the smaller id.

    Vectors are compared only with those of their own length; null, empty and zero vectors have no neighbours. Ids are
    expected to be unique. No queries or no rows give an empty result.
    """
    spark = rows.sparkSession
    q = queries.where(F.col(vector).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    r = rows.where(F.col(vector).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = q.count()
    blocks = max(1, -(-n // BLOCK))
    out = None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(x.v) for x in part if x.v}:
            own = [x for x in part if len(x.v) == size]
            m = np.array([x.v for x in own], np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            ok = norm[:, 0] > 0
            by[size] = (np.array([x.id for x in own], np.int64)[ok], m[ok] / norm[ok])
        sent = spark.sparkContext.broadcast(by)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.asarray(batch.column(0))
                vs = batch.column(1).to_pylist()
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for size, (qid, qm) in sent.value.items():
                    at = [i for i, v in enumerate(vs) if v is not None and len(v) == size]
                    if not at or not len(qid):
                        continue
                    m = np.array([vs[i] for i in at], np.float64)
                    norm = np.linalg.norm(m, axis=1)
                    ok = norm > 0
                    m, rid = m[ok] / norm[ok][:, None], ids[at][ok]
                    score = np.round(qm @ m.T, 6)
                    i, j = np.nonzero(score > threshold if strict else score >= threshold)
                    found.append((qid[i], rid[j], score[i, j]))
                if found:
                    a, c, s = (np.concatenate(x) for x in zip(*found))
                    away = a != c
                    yield pa.RecordBatch.from_pydict({"id": pa.array(a[away]), "neighbour": pa.array(c[away]), "score": pa.array(s[away])})

        # A query is in one block, so what is best of a block is best of all.
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour"))
        got = r.mapInArrow(search, "id bigint, neighbour bigint, score double").withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
        if blocks > 1:  # one block after the other, so that one broadcast is held at a time
            got = cut(got)
            sent.unpersist()
        out = got if out is None else out.unionByName(got)
    return out
