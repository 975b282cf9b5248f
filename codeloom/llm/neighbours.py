"""The k most similar vectors for every vector, by vantage-point trees.

Cosine similarity on unit vectors is Euclidean distance: |a-b|^2 = 2 - 2 cos. A search for similarities of at least
`least` is a range search of radius r = sqrt(2 - 2 least), for which a node with vantage point v and ball radius mu has
to be entered inside only if d(q, v) - mu <= r and outside only if mu - d(q, v) <= r. The bounds are relaxed by a factor:
a path is followed as long as the margins by which it left the query's own side, squared and added up, stay below
(r / factor)^2; earlier margins count by 1 - 1 / factor. A factor of one leaves each bound as it is, which is exact.

1. Equal vectors are one point with the k + 1 smallest of its ids, so copies cost nothing however many they are.
2. Trees fitted on bounded samples cut the space into shards. By each tree every point goes to one shard, as point and
   query, and as query to the further shards that its bounds reach; all in one shuffle by shard. Several trees of a large
   factor take fewer copies of a query than one of a small factor, and their number hardly grows with the table. Shards
   that are still too large are cut again by trees fitted on samples of their own.
3. In each shard a tree of its own is built on all its points, and the shard's queries go down together: a node is one
   matrix product. Leaves are searched exhaustively.
4. The best of all shards are merged by query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, release

#: Rows of a sample on which shards are cut (a bound on what the driver and a fitting task hold), points a shard, points a leaf.
SAMPLE = 8_192
SHARD = 8_192
LEAF = 256
#: Parts into which one tree cuts a sample at most, so that each part has some rows of it.
FAN = SAMPLE // 8
#: Relaxation of the triangle inequality within shards, and between them, where TREES trees make up for what one loses.
FACTOR = 8.0
ROUTE_FACTOR = 40.0
TREES = 3
#: Rows that one task cuts again.
PART = 50_000

_ROUTED = "cell string, home boolean, spent float, key bigint, vec binary"


class Node:
    __slots__ = ("inside", "leaf", "mu", "outside", "vantage")

    def __init__(self, leaf=None, vantage=None, mu=0.0, inside=None, outside=None) -> None:
        self.leaf, self.vantage, self.mu, self.inside, self.outside = leaf, vantage, mu, inside, outside


def _distance(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ v), 0.0))


def _vantage(x: np.ndarray, rng: np.random.Generator, tries: int, band: float) -> tuple[np.ndarray, float]:
    """The vantage point and radius near the median that the fewest points are close to, so that few queries reach both
    sides. Any point of the sphere is a lawful one: some points of the node, its longest directions and mixtures of them,
    and directions from one point to another are tried."""
    part = x if len(x) <= 128 * tries else x[rng.choice(len(x), 128 * tries, replace=False)]
    c = part - part.mean(0)
    axes = np.linalg.eigh(c.T @ c)[1].T[::-1][:tries]
    mixed = rng.standard_normal((tries, min(8, len(axes))), np.float32) @ axes[:8]
    i, j = rng.integers(0, len(part), (2, tries))
    some = np.concatenate([mixed, part[i] - part[j]])
    size = np.linalg.norm(some, axis=1)
    some = some[size > 1e-6] / size[size > 1e-6, None]
    candidates = np.concatenate([part[rng.integers(0, len(part), max(2, tries // 3))], axes, some]).astype(np.float32)
    d = np.sort(np.sqrt(np.maximum(2.0 - 2.0 * (part @ candidates.T), 0.0)), axis=0)
    n = len(part)
    lo = int(n * 0.3)
    hi = max(int(n * 0.7), lo + 1)
    best = (n + 1, candidates[0], float(d[n // 2, 0]))
    for k in range(d.shape[1]):
        s = d[:, k]
        radii = (s[lo:hi] + s[np.minimum(np.arange(lo, hi) + 1, n - 1)]) / 2
        near = np.searchsorted(s, radii + band) - np.searchsorted(s, radii - band)
        a = int(np.argmin(near))
        if near[a] < best[0]:
            best = (int(near[a]), candidates[k], float(radii[a]))
    return best[1], best[2]


def build(x: np.ndarray, leaf: int, seed: int = 7, tries: int = 4, band: float = 0.08) -> tuple[Node, list[np.ndarray]]:
    """The tree over the rows of x and its leaves; points that cannot be parted stay in one leaf."""
    rng = np.random.default_rng(seed)
    leaves: list[np.ndarray] = []

    def grow(rows: np.ndarray) -> Node:
        if len(rows) > leaf:
            v, mu = _vantage(x[rows], rng, tries, band)
            inside = _distance(x[rows], v) <= mu
            if 0 < inside.sum() < len(rows):
                return Node(vantage=v, mu=mu, inside=grow(rows[inside]), outside=grow(rows[~inside]))
        leaves.append(rows)
        return Node(leaf=len(leaves) - 1)

    return grow(np.arange(len(x))), leaves


def reach(node: Node, x: np.ndarray, bound: float, keep: float = 0.0, spent: np.ndarray | None = None, home: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(leaf, queries that reach it, what they have spent of bound squared, whether the leaf is their own). `keep` is how
    much of what was spent before counts; with 0 each node is judged by its own margin."""

    def down(node: Node, rows: np.ndarray, spent: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        if not len(rows):
            return
        if node.leaf is not None:
            yield node.leaf, rows, spent, home
            return
        over = _distance(x[rows], node.vantage) - node.mu
        inside = over <= 0
        for child, own, margin in ((node.inside, inside, over), (node.outside, ~inside, -over)):
            now = np.where(own, spent, keep * spent + margin * margin).astype(np.float32)
            go = own | (now <= bound * bound)
            yield from down(child, rows[go], now[go], (home & own)[go])

    n = len(x)
    yield from down(node, np.arange(n), np.zeros(n, np.float32) if spent is None else spent, np.ones(n, bool) if home is None else home)


def _bound(least: float, factor: float) -> tuple[float, float]:
    return float(np.sqrt(2 - 2 * least)) / factor + 1e-4, 1 - 1 / factor


def _search(points: np.ndarray, queries: np.ndarray, k: int, least: float, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point row, similarity) of the k best points of each query among those of at least `least`."""
    tree, leaves = build(points, LEAF)
    qs, ps, ss = [], [], []
    edge = np.float32(least - 2e-6)
    for leaf, rows, _, _ in reach(tree, queries, *_bound(least, factor)):
        own = leaves[leaf]
        block = points[own]
        for a in range(0, len(rows), 4096):
            part = rows[a : a + 4096]
            sim = queries[part] @ block.T
            i, j = np.nonzero(sim >= edge)
            if len(i):
                qs.append(part[i])
                ps.append(own[j])
                ss.append(sim[i, j])
    if not qs:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.float64)
    q, p, s = np.concatenate(qs), np.concatenate(ps), np.concatenate(ss)
    order = np.lexsort((-s, q))
    q, p, s = q[order], p[order], s[order]
    first = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    # Ties at the edge of the k best: what equals the k-th in six decimals stays, the ids decide later.
    kth = np.full(int(q.max()) + 1, -2.0)
    last = rank == k - 1
    kth[q[last]] = s[last]
    keep = (rank < k) | (s >= kth[q] - 1.5e-6)
    q, p = q[keep], p[keep]
    s = np.empty(len(q), np.float64)
    for a in range(0, len(q), 65_536):  # the six decimals need sums in double precision
        b = slice(a, a + 65_536)
        s[b] = np.einsum("ij,ij->i", queries[q[b]], points[p[b]], dtype=np.float64)
    return q, p, s


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def usable_vectors(vectors: DataFrame, dim: int, vec_id: str, embedding: str) -> DataFrame:
    """id, e (the vector in doubles), key of its equals: of every vector of the given number of values, all finite, not all
    zero."""
    ok = (F.size(embedding) == dim) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("1e300"))) & F.exists(embedding, lambda x: x != 0)
    v = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ok).select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    return v.withColumn("same", F.concat(F.xxhash64("e"), F.lit(":"), F.hash("e")))


def _rows(cells: list, home: np.ndarray, spent: np.ndarray, key: pa.Array, vec: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array(home), pa.array(spent, pa.float32()), key, vec], ["cell", "home", "spent", "key", "vec"])


def shards_of(points: DataFrame, n: int, dim: int, least: float, factor: float = ROUTE_FACTOR, trees: int = TREES, shard: int | None = None, sample: int = SAMPLE, fan: int = FAN) -> DataFrame:
    """cell, home, spent, key, vec: each of the n points (key, vec) in the shard that each tree puts it in (home), and in the
    further shards in which its neighbours may be. A shard has some `shard` points whatever n is: one of more than four
    times as many is cut again, as often as it takes. A factor of one needs one tree only."""
    spark = points.sparkSession
    shard = shard or SHARD
    bound, keep = _bound(least, factor)
    want = -(-n // shard)
    trees = 1 if factor <= 1 or want <= 1 else trees
    rows = points.select("vec").orderBy(F.xxhash64("vec")).limit(sample).collect() if want > 1 else []
    x = np.frombuffer(b"".join(r.vec for r in rows), np.float32).reshape(-1, dim)
    fit = lambda x, want, seed: build(x, max(1, len(x) // min(want, fan)), seed, 16)[0]
    routers = spark.sparkContext.broadcast([fit(x, want, t) if want > 1 else Node(leaf=0) for t in range(trees)])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), dim)
                for t, router in enumerate(routers.value):
                    for leaf, at, spent, home in reach(router, x, bound, keep):
                        part = b.take(pa.array(at))
                        yield _rows([f"{t}.{leaf}"] * len(at), home, spent, part.column(0), part.column(1))

    out = points.select("key", "vec").mapInArrow(first, _ROUTED)
    if want <= 1:
        return out

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dim)
                for t, router in enumerate(routers.value):
                    for leaf, _, _, home in reach(router, x, 0.0):
                        n[f"{t}.{leaf}"] = n.get(f"{t}.{leaf}", 0) + int(home.sum())
        yield pa.RecordBatch.from_pydict({"cell": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    large = F.col("n") > 4 * shard
    big = cut(points.select("vec").mapInArrow(homes, "cell string, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(large))

    def fit_cell(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("vec").combine_chunks(), dim)
        router = fit(x, -(-t.column("n")[0].as_py() // shard), 7)
        return pa.table({"cell": t.column("cell").slice(0, 1), "n": t.column("n").slice(0, 1), "router": pa.array([pickle.dumps(router)], pa.binary())})

    def divide(left: pa.Table, right: pa.Table) -> pa.Table:
        router = pickle.loads(right.column("router")[0].as_py())
        cell = right.column("cell")[0].as_py()
        out = []
        for b in left.combine_chunks().to_batches():
            x = _matrix(b.column("vec"), dim)
            for leaf, at, spent, home in reach(router, x, bound, keep, np.array(b.column("spent")), np.array(b.column("home").to_numpy(False))):
                part = b.take(pa.array(at))
                out.append(_rows([f"{cell}.{leaf}"] * len(at), home, spent, part.column("key"), part.column("vec")))
        return pa.Table.from_batches(out, _rows([], np.empty(0, bool), np.empty(0, np.float32), pa.array([], pa.int64()), pa.array([], pa.binary())).schema)

    while not big.isEmpty():
        out = cut(out)
        mine = out.join(big, "cell")
        drawn = mine.where("home").withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("vec"), "key"))).where(F.col("rank") <= sample)
        fitted = cut(drawn.select("cell", "n", "vec").groupBy("cell").applyInArrow(fit_cell, "cell string, n bigint, router binary"))
        salts = F.ceil(F.col("n") / PART).cast("int")
        left = mine.withColumn("salt", F.pmod(F.xxhash64("key"), salts).cast("int")).select("cell", "salt", "home", "spent", "key", "vec")
        right = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        parted = cut(left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInArrow(divide, _ROUTED))
        out = out.join(big.select("cell"), "cell", "left_anti").unionByName(parted)
        # A shard that its tree could not part (all points at one place) stays as it is.
        sizes = parted.where("home").groupBy("cell").agg(F.count("*").alias("n")).where(large)
        before = fitted.select(F.concat("cell", F.lit(".0")).alias("cell"), F.col("n").alias("before"))
        big = cut(sizes.join(before, "cell", "left").where("before is null or n < before").select("cell", "n"))
    return out


def similar(vectors: DataFrame, dim: int, k: int = 10, least: float = 0.8, factor: float = FACTOR, vec_id: str = "id", embedding: str = "embedding", route_factor: float | None = None, trees: int = TREES, **sizes: int) -> DataFrame:
    """id, neighbour, similarity (rounded half up to six decimals): for each vector its k most similar others of at
    least `least`, ties to the smaller id.

    One row per id is expected; of repeated ids any row may be used, so drop them first. Null ids or vectors, vectors of
    another length, with null, NaN or infinite values, or all zero take no part. Equal vectors are neighbours of
    similarity one. Other columns do not matter. An empty table gives an empty result. A factor of one is exact: it is
    used between shards too, unless route_factor is given.
    """
    v = usable_vectors(vectors, dim, vec_id, embedding)
    ranked = v.withColumn("rank", F.row_number().over(Window.partitionBy("same").orderBy("id"))).where(F.col("rank") <= k + 1)
    points = ranked.groupBy("same").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("e", "id").alias("e"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(3).flatten(), np.float64).reshape(-1, dim)
            x = x / np.abs(x).max(1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "same", "ids", "vec"])

    # The smallest id of a vector stands for it.
    points = cut(points.select(F.col("ids")[0].alias("key"), "same", "ids", "e").mapInArrow(unit, "key bigint, same string, ids array<bigint>, vec binary"))
    n = points.count()

    def search(table: pa.Table) -> pa.Table:
        home = np.asarray(table.column("home"))
        x = _matrix(table.column("vec").combine_chunks(), dim)
        own = np.flatnonzero(home)
        key = np.asarray(table.column("key"))
        if len(own):
            q, p, s = _search(x[own], x, k + 1, least, factor)
        else:
            q = p = np.empty(0, np.int64)
            s = np.empty(0, np.float64)
        other = key[own[p]]
        away = key[q] != other
        return pa.table({"key": key[q][away], "other": other[away], "similarity": np.floor(s[away] * 1e6 + 0.5) / 1e6})

    routed = shards_of(points, n, dim, least, route_factor or (ROUTE_FACTOR if factor > 1 else 1.0), trees, **sizes)
    hits = routed.groupBy("cell").applyInArrow(search, "key bigint, other bigint, similarity double").where(F.col("similarity") >= least)
    # Several trees find a pair several times; all of a key is in one place already when they are dropped.
    best_of = Window.partitionBy("key").orderBy(F.desc("similarity"), "other")
    near = hits.repartition("key").groupBy("key", "other").agg(F.max("similarity").alias("similarity")).withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") <= k + 1)
    # From points to ids: most points have one, their own; the equals of a point are neighbours of it too.
    many = points.where(F.size("ids") > 1).select(F.col("key").alias("other"), F.col("ids").alias("others"))
    near = near.join(many, "other", "left").select("key", F.explode(F.coalesce("others", F.array("other"))).alias("neighbour"), "similarity")
    near = near.unionByName(many.select(F.col("other").alias("key"), F.explode("others").alias("neighbour"), F.lit(1.0).alias("similarity")))
    # The k + 1 best ids of each point, its own copies among them: enough for each of its ids without itself.
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("rank") <= k + 1)
    best = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("neighbour").alias("neighbour")))).alias("best"))
    best = cut(best.join(points.select("key", "same", "ids"), "key"))
    release(points)
    each = best.select(F.explode("ids").alias("id"), "best")
    # Ids beyond the k + 1 smallest of a vector: the list holds none of them, so all of these ids have the same
    # neighbours. The few lists are spread over salts, for one vector may have a third of all ids.
    salts = 32
    full = best.where(F.size("ids") > k).select("same", "best", F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("salt"), F.element_at("ids", -1).alias("last"))
    more = v.select("same", "id", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")).join(full, ["same", "salt"]).where("id > last").select("id", "best")
    out = each.unionByName(more).select("id", F.slice(F.filter("best", lambda t: t["neighbour"] != F.col("id")), 1, k).alias("b"))
    return out.select("id", F.explode("b").alias("t")).select("id", "t.neighbour", (-F.col("t.s")).alias("similarity"))
