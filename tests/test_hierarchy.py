import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import hierarchy as H


def brute(edges):
    up = {}
    for p, c in sorted({e for e in edges if None not in e}, reverse=True):
        up[c] = p
    nodes = {x for e in edges if None not in e for x in e}
    out = {}
    for n in nodes:
        path, seen = [n], {n}
        while path[-1] in up and up[path[-1]] not in seen:
            path.append(up[path[-1]])
            seen.add(path[-1])
        if path[-1] not in up:
            out[n] = (path[-1], len(path) - 1, 0, tuple(reversed(path)))
            continue
        ring = path[path.index(up[path[-1]]) :]
        k = next(i for i, x in enumerate(path) if x in ring)
        out[n] = (min(ring), k, int(k == 0), tuple(reversed(path[: k + 1])))
    return out


def run(spark, edges):
    df = spark.createDataFrame(edges or [(None, None)], "a bigint, b bigint")
    return {r.node: (r.root, r.depth, r.on_cycle, tuple(r.path)) for r in H.link_hierarchies(df, "a", "b").collect()}


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(1, 2), (2, 3), (3, 4), (1, 5)],
        [(1, 2), (1, 2), (None, 3), (3, None)],
        [(7, 7)],
        [(1, 2), (2, 1), (2, 3), (3, 4)],
        [(5, 3), (3, 9), (9, 5), (9, 1), (1, 2), (8, 6)],
        [(i, i + 1) for i in range(1, 40)],
        [(i, i % 13 + 1) for i in range(1, 14)] + [(13, 20), (20, 21)],
    ],
)
def test_against_brute_force(spark, edges):
    assert run(spark, edges) == brute(edges)


def test_random_forests_with_rings(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), c) for c in range(60) if rnd.random() < 0.9]
    assert run(spark, edges) == brute(edges)


def test_several_parents_follow_the_smallest(spark, rows):
    df = spark.createDataFrame([(2, 9), (1, 9), (3, 9)], "a bigint, b bigint")
    assert ((9, 1, 1)) in rows(H.link_hierarchies(df, "a", "b", with_path=False).select("node", "root", "depth"))
    assert rows(H.multiple_parents(df, "a", "b")) == [(9, 3, 1)]


def test_clashing_columns_and_strings(spark, rows):
    df = spark.createDataFrame([("x", "y", 1), ("y", "z", 2)], "node string, anc string, dist int")
    assert rows(H.link_hierarchies(df, "node", "anc").select("node", "root", "depth", F.array_join("path", "/"))) == [("x", "x", 0, "x"), ("y", "x", 1, "x/y"), ("z", "x", 2, "x/y/z")]


def test_descendants(spark, rows):
    h = H.link_hierarchies(spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "a bigint, b bigint"), "a", "b")
    assert rows(H.descendants(h)) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)]
    assert rows(H.descendant_counts(h)) == [(1, 3, 2), (2, 1, 1), (3, 0, 0), (4, 0, 0)]
