"""Parent-child links to full hierarchies by pointer doubling.

Every node holds a pointer to an ancestor 2^k links above it. One join of the pointers with themselves doubles the
distance, so a tree of depth d is resolved in log2(d) + 1 joins. Rows that have reached their root leave the join.
A round in which no row is resolved shows that the rest never will be: those nodes lie on rings or below them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut, read_cuts, release


def _resolve(top: DataFrame, active: DataFrame, with_path: bool) -> tuple[DataFrame, DataFrame, int]:
    """top: the roots, active: all other nodes, both node, anc, dist, done, low[, seg]; a root has anc = node, dist 0.
    Gives the rows that reached a root, the rows that never will, and the number of those.

    A round joins only the rows that still climb; each resolved row is written once and never again.
    """
    climbs = Observation()
    written = [cut(top)]
    active = cut(active.observe(climbs, F.count("*").alias("left")))
    left = climbs.get["left"]
    while left:
        cols = [F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("d2"), F.col("done").alias("done2"), F.col("low").alias("low2"), *([F.col("seg").alias("seg2")] if with_path else [])]
        # All that is done and all that climbs, as one scan.
        a = read_cuts(*written).where("done").unionByName(active.where("not done")).select(*cols)
        moved = active.where("not done").join(a, "anc").select(
            "node",
            F.col("anc2").alias("anc"),
            (F.col("dist") + F.col("d2")).alias("dist"),
            F.col("done2").alias("done"),
            F.least("low", "low2").alias("low"),
            *([F.concat("seg2", "seg").alias("seg")] if with_path else []),
        )
        climbs = Observation()
        both = cut(moved.observe(climbs, F.count_if(~F.col("done")).alias("left")))
        if not any(active is w for w in written):
            release(active)
        written.append(both)
        active, now = both, climbs.get["left"]
        if now == left:
            break
        left = now
    return read_cuts(*written).where("done"), active.where("not done"), left


def link_hierarchies(links: DataFrame, parent: str, child: str, with_path: bool = True) -> DataFrame:
    """One row per node: function of links alone, whatever other columns there are.

    Result: node, root, depth (links from the root), on_cycle (1 on a ring), path (array from root to node, both
    included; only with with_path).

    - Links with a null end are no links; repeated links count once.
    - A child with several parents follows the smallest parent id (a forest needs one; ties are impossible).
    - On a ring: root is the smallest node of the ring, depth 0, path the node alone. Below a ring: root as for the
      ring, depth and path from the node of the ring above it.
    - An empty table gives an empty result.
    """
    ends = cut(links.select(F.col(parent).alias("p"), F.col(child).alias("node")).where("p is not null and node is not null").distinct())
    edges = ends.groupBy("node").agg(F.min("p").alias("p"))
    kind = dict(edges.dtypes)["node"]
    roots = ends.select(F.col("p").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
    seg = (lambda *c: [F.array(*c).alias("seg")]) if with_path else (lambda *c: [])
    up = edges.select("node", F.col("p").alias("anc"), F.lit(1).cast("int").alias("dist"), F.lit(False).alias("done"), F.least("node", "p").alias("low"), *seg(F.col("node")))
    top = roots.select("node", F.col("node").alias("anc"), F.lit(0).cast("int").alias("dist"), F.lit(True).alias("done"), F.col("node").alias("low"), *seg(F.col("node")))
    trees, rest, left = _resolve(top, up, with_path)
    path = [F.col("seg").alias("path")] if with_path else []
    out = trees.select("node", F.col("anc").alias("root"), F.col("dist").alias("depth"), F.lit(0).cast("int").alias("on_cycle"), *path)
    if not left:
        return out

    # Rings and what hangs below them: double until the pointers have passed every tail; what they then point at is the ring.
    cyclic = cut(rest.select("node").join(edges, "node"))
    ring = cyclic.select("node", F.col("p").alias("anc"), F.least("node", "p").alias("low"))
    for k in range(max(1, math.ceil(math.log2(left + 1)))):
        a = ring.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("low").alias("low2"))
        ring = ring.join(a, "anc").select("node", F.col("anc2").alias("anc"), F.least("low", "low2").alias("low"))
        if k % 3 == 2:
            ring = cut(ring)
    members = cut(ring.select(F.col("anc").alias("node")).distinct().join(ring.select("node", "low"), "node"))
    on = members.select("node", F.col("low").alias("root"), F.lit(0).cast("int").alias("depth"), F.lit(1).cast("int").alias("on_cycle"), *([F.array("node").cast(f"array<{kind}>").alias("path")] if with_path else []))
    tails = cyclic.join(members.select("node"), "node", "left_anti").select("node", F.col("p").alias("anc"), F.lit(1).cast("int").alias("dist"), F.lit(False).alias("done"), F.col("node").alias("low"), *seg(F.col("node")))
    tops = members.select("node", F.col("node").alias("anc"), F.lit(0).cast("int").alias("dist"), F.lit(True).alias("done"), F.col("node").alias("low"), *seg(F.col("node")))
    below, _, _ = _resolve(tops, tails, with_path)
    below = below.where("dist > 0").join(members.select(F.col("node").alias("anc"), F.col("low").alias("ring_low")), "anc")
    below = below.select("node", F.col("ring_low").alias("root"), F.col("dist").alias("depth"), F.lit(0).cast("int").alias("on_cycle"), *path)
    return out.unionByName(on).unionByName(below)


def descendants(hierarchy: DataFrame) -> DataFrame:
    """All pairs (node, descendant, distance) of a hierarchy with paths. Rows, not arrays: the descendants of one node
    may be most of the table, and no task has to hold them."""
    at = hierarchy.select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("pos", "node"))
    return at.where("node <> descendant").select("node", "descendant", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))


def descendant_counts(hierarchy: DataFrame) -> DataFrame:
    """Number of descendants and height below every node of a hierarchy with paths; counted map-side before any shuffle."""
    pairs = hierarchy.select("depth", F.posexplode("path").alias("pos", "node"))
    return pairs.groupBy("node").agg((F.count("*") - 1).alias("descendants"), F.max(F.col("depth") - F.col("pos")).cast("int").alias("height"))


def multiple_parents(links: DataFrame, parent: str, child: str) -> DataFrame:
    """Children with more than one distinct parent: what keeps the links from being a forest."""
    return links.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(F.col(parent).alias("parent"), F.col(child).alias("node")).distinct().groupBy("node").agg(F.count("*").alias("parents"), F.min("parent").alias("kept")).where("parents > 1")


__all__ = ["descendant_counts", "descendants", "link_hierarchies", "multiple_parents"]
