import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import neighbours as N

DIM = 16
SCHEMA = "id bigint, embedding array<double>, ids int, vec string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)


def brute(rows, k, least):
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == DIM and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in ok])
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    out = set()
    for a in range(len(ids)):
        s = np.floor((x @ x[a]) * 1e6 + 0.5) / 1e6
        for j in [j for j in np.lexsort((ids, -s)) if j != a and s[j] >= least][:k]:
            out.add((int(ids[a]), int(ids[j])))
    return out


def clustered(n, seed=3, spread=0.25):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 12 + 1, DIM))
    return [(i + 1, (centres[r.integers(len(centres))] + spread * r.standard_normal(DIM)).tolist()) for i in range(n)]


def pairs(df):
    return {(r.id, r.neighbour) for r in df.collect()}


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD", 120)
    monkeypatch.setattr(N, "LEAF", 16)
    rows = clustered(400)
    assert pairs(N.similar(frame(spark, rows), DIM, 5, 0.8, factor=1.0)) == brute(rows, 5, 0.8)


def test_recall_with_pruning(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD", 300)
    monkeypatch.setattr(N, "LEAF", 32)
    rows = clustered(1500)
    want, got = brute(rows, 10, 0.8), pairs(N.similar(frame(spark, rows), DIM, 10, 0.8, factor=2.0))
    assert len(want & got) >= 0.95 * len(want)


def test_bad_vectors_take_no_part(spark):
    v = [1.0] + [0.0] * (DIM - 1)
    bad = [(2, None), (3, []), (4, [0.0] * DIM), (5, v[:-1]), (6, [float("nan")] * DIM), (7, [float("inf")] + v[1:]), (8, [None] + v[1:]), (None, v)]
    assert pairs(N.similar(frame(spark, [(1, v), (9, [2 * x for x in v]), *bad]), DIM)) == {(1, 9), (9, 1)}


def test_hot_copies(spark):
    rows = clustered(60)
    v = rows[0][1]
    rows += [(1000 + i, v) for i in range(200)]
    assert pairs(N.similar(frame(spark, rows), DIM, 10, 0.8, factor=1.0)) == brute(rows, 10, 0.8)


def test_empty(spark):
    assert N.similar(frame(spark, []), DIM).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7])
def test_one_value(spark, n):
    rows = [(i, [1.0] * DIM) for i in range(n)]
    assert pairs(N.similar(frame(spark, rows), DIM, 3)) == brute(rows, 3, 0.8)


def test_scores(spark):
    df = N.similar(frame(spark, [(1, [1.0, 0.5] + [0.0] * 14), (2, [1.0] + [0.0] * 15)]), DIM)
    assert [r.similarity for r in df.orderBy("id").collect()] == [0.894427, 0.894427] and df.where(F.col("id") == F.col("neighbour")).count() == 0


def test_production_settings_keep_recall(spark):
    """Factors and trees as they are used, over shards that are cut again from samples of their own."""
    r = np.random.default_rng(5)
    centres = r.standard_normal((500, 96))
    x = [(centres[i % 500] + 0.45 * r.standard_normal(96)) for i in range(4000)]
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)]
    u = np.array([v / np.linalg.norm(v) for v in x])
    want = set()
    for a in range(len(u)):
        s = u @ u[a]
        want |= {(a + 1, int(j) + 1) for j in np.argsort(-s)[1:11] if s[j] >= 0.8}
    got = pairs(N.similar(frame(spark, rows), 96, 10, 0.8, shard=100, sample=256, fan=4))
    assert len(want) > 10_000 and len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(got)


def test_exact_over_shards_that_are_cut_again(spark):
    rows = clustered(600)
    v = frame(spark, rows)
    assert pairs(N.similar(v, DIM, 5, 0.8, factor=1.0, shard=20, sample=64, fan=3)) == brute(rows, 5, 0.8)


@pytest.mark.parametrize("n", [1000, 16000])
def test_copies_hardly_grow(spark, n):
    r = np.random.default_rng(9)
    centres = r.standard_normal((n // 20, 96))
    x = (centres[np.arange(n) % len(centres)] + 0.45 * r.standard_normal((n, 96))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "key bigint, vec binary")
    per = N.shards_of(points, n, 96, 0.8, shard=64, sample=2048, fan=64).count() / n
    assert N.TREES <= per <= 4 * N.TREES
