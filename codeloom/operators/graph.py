"""Graphs as edge tables (src, dst). Walks go by frontiers: each round joins only the nodes that the last one reached, and
drops what was seen before, so a node is expanded once however many paths lead to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, release


def walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, depth (shortest, from 1) of all nodes within depth links of each seed (a frame with column seed).

    The seed itself does not come out, even if a ring leads back to it. Null ends are no edges.
    """
    e = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    seen = cut(seeds.where("seed is not null").select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct())
    frontier, parts = seen, [seen]
    for k in range(1, depth + 1):
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        step = frontier.select("seed", "node").join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(known.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            release(frontier)
            break
        parts.append(frontier)
    out = parts[1] if len(parts) > 1 else parts[0].where("false")
    for p in parts[2:]:
        out = out.unionByName(p)
    return out


def walk_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, depth, path (nodes from seed to node) of all nodes within depth links of each seed: of the shortest paths
    the smallest. A node is expanded once, by the path kept for it, so the number of paths does not matter.

    The seed itself does not come out, even if a ring leads back to it. Null ends are no edges.
    """
    e = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    frontier = cut(seeds.where("seed is not null").select("seed", F.col("seed").alias("node"), F.array("seed").alias("path")).distinct())
    parts = [frontier]
    for _ in range(depth):
        known = parts[0].select("seed", "node")
        for p in parts[1:]:
            known = known.unionByName(p.select("seed", "node"))
        step = frontier.join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).groupBy("seed", "node").agg(F.min("path").alias("path"))
        frontier = cut(step.join(known, ["seed", "node"], "left_anti"))
        if frontier.isEmpty():
            release(frontier)
            break
        parts.append(frontier)
    release(e)
    out = parts[1] if len(parts) > 1 else parts[0].where("false")
    for p in parts[2:]:
        out = out.unionByName(p)
    return out.select("seed", "node", (F.size("path") - 1).alias("depth"), "path")


def rings(edges: DataFrame) -> DataFrame:
    """node, ring (its smallest node), size of all nodes that lie on a cycle of any length: strongly connected components of
    more than one node, and nodes that point to themselves.

    Nodes without a way in or out are taken off first, as long as there are any. Then each node takes the smallest node
    that it can be reached from (its colour), and what can go back to that node within the colour is its ring; the rings
    of all colours are taken off at once and the rest goes round again. A round is a few joins over what is left; their
    number goes with the length of the longest way through it. Each round is written to the shared folder.
    """
    e = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    loops = e.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("ring"))
    e = cut(e.where("src <> dst"))
    n = e.count()
    found: list[DataFrame] = []
    while n:
        while True:  # trim
            ends = e.select(F.col("src").alias("dst")).distinct()
            less = cut(e.join(ends, "dst", "left_semi").join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
            release(e)
            e, before, n = less, n, less.count()
            if n == before:
                break
        if not n:
            break
        colour = _spread(e, cut(e.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node"))))
        c = colour.select(F.col("node").alias("src"), F.col("colour").alias("c1"))
        own = e.join(c, "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("colour"))
        own = cut(own)
        back = cut(colour.where("node = colour").select("node", "colour"))
        frontier = back
        while True:  # from the colour's node against the links
            step = frontier.withColumnRenamed("node", "dst").join(own, ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            frontier = cut(step.join(back, ["node", "colour"], "left_anti"))
            if frontier.isEmpty():
                break
            back = cut(back.unionByName(frontier))
        found.append(back.select("node", F.col("colour").alias("ring")))
        gone = back.select("node")
        rest = cut(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        release(e, own)
        e, n = rest, rest.count()
    out = loops
    for f in found:
        out = out.unionByName(f)
    out = cut(out.groupBy("node").agg(F.min("ring").alias("ring")))
    size = out.groupBy("ring").agg(F.count("*").alias("size"))
    looped = loops.select("node", F.lit(1).alias("loop"))
    return out.join(size, "ring").join(looped, "node", "left").where("size > 1 or loop = 1").select("node", "ring", "size")


def _spread(e: DataFrame, colour: DataFrame) -> DataFrame:
    """The smallest colour that reaches each node along the links, until nothing changes."""
    while True:
        into = colour.select(F.col("node").alias("src"), F.col("colour").alias("c")).join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("c"))
        new = colour.join(into, "node", "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("changed"))
        new = cut(new)
        release(colour)
        colour = new.select("node", "colour")
        if new.where("changed").isEmpty():
            return colour


def cycles_of(cycles: DataFrame) -> DataFrame:
    """node, cycle, length: the cycles (cycle, length) in which each node lies."""
    return cycles.select(F.explode("cycle").alias("node"), "cycle", "length")


def nested_modules(modules: DataFrame) -> DataFrame:
    """a, b: modules of which a lies below b (column module, paths with slashes): an equi-join of each path's beginnings."""
    m = modules.select("module").where("module <> ''").distinct()
    parts = F.split("module", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    a = m.where(F.size(parts) > 1).select(F.col("module").alias("a"), F.explode(above).alias("module"))
    return a.join(m, "module").select("a", F.col("module").alias("b"))


def dependents_by_source(imports: DataFrame, targets: DataFrame) -> DataFrame:
    """project_id, target, dependents: how many files import each target itself or something below it, by the text of the
    import alone. imports: project_id, file_id, source; targets: project_id, target. The condition equal or below is an
    equi-join of the beginnings of each source, which pre-aggregates to one row a file and beginning."""
    parts = F.split("source", "/")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    i = imports.where("source is not null and source <> ''").select("project_id", "file_id", F.explode(starts).alias("target")).distinct()
    return i.join(targets.select("project_id", "target").distinct(), ["project_id", "target"]).groupBy("project_id", "target").agg(F.count("*").alias("dependents"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def dependents(edges: DataFrame) -> DataFrame:
    """node, dependents: how many others point to it directly."""
    return edges.where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("dependents"))


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """seed, direct, medium, low, total, risk of what depends on each seed."""
    w = walk(reverse(edges), seeds, depth)
    g = w.groupBy("seed").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") == 2).alias("medium"), F.count_if(F.col("depth") > 2).alias("low"), F.count("*").alias("total"))
    risk = F.when(F.col("direct") > 5, "high").when((F.col("direct") > 2) | (F.col("medium") > 5), "medium").otherwise("low")
    return g.withColumn("risk", risk)


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (a frame with column node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def short_cycles(edges: DataFrame, longest: int = 3) -> DataFrame:
    """cycle (array, smallest node first), length of all simple cycles of up to `longest` nodes, loops included.

    Paths grow only through nodes greater than their start, so each cycle is found once, from its smallest node.
    """
    e = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    loops = e.where("src = dst").select(F.array("src").alias("cycle"))
    up = e.where("src <> dst")
    paths = up.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("tip"), F.col("src").alias("start"))
    found = loops
    for k in range(2, longest + 1):
        closing = up.select(F.col("src").alias("tip"), F.col("dst").alias("start"))
        found = found.unionByName(paths.join(closing, ["tip", "start"]).select(F.col("path").alias("cycle")))
        if k < longest:
            nxt = up.select(F.col("src").alias("tip"), F.col("dst").alias("next"))
            paths = paths.join(nxt, "tip").where((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next"))).select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("tip"), "start")
    return found.select("cycle", F.size("cycle").alias("length"))


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs a < b that point to each other."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src").distinct()
    return e.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2").select("a", "b")


def coupling(edges: DataFrame, module: DataFrame, abstractness: DataFrame | float = 0.0) -> DataFrame:
    """Afferent and efferent coupling, abstractness, instability, distance and kind of each module; module: node, module;
    abstractness: one share for all, or module, abstractness (none or null: 0)."""
    m = module.select("node", "module")
    e = edges.join(m.select(F.col("node").alias("src"), F.col("module").alias("a")), "src").join(m.select(F.col("node").alias("dst"), F.col("module").alias("b")), "dst").where("a <> b").select("a", "b").distinct()
    ce = e.groupBy(F.col("a").alias("module")).agg(F.count("*").alias("ce"))
    ca = e.groupBy(F.col("b").alias("module")).agg(F.count("*").alias("ca"))
    j = m.select("module").distinct().join(ca, "module", "left").join(ce, "module", "left").na.fill(0, ["ca", "ce"])
    if isinstance(abstractness, DataFrame):
        j = j.join(abstractness.select("module", F.col("abstractness").alias("_a")), "module", "left")
    else:
        j = j.withColumn("_a", F.lit(abstractness))
    a = F.coalesce("_a", F.lit(0.0))
    i = F.coalesce(F.try_divide(F.col("ce").cast("double"), (F.col("ca") + F.col("ce")).cast("double")), F.lit(0.0))
    kind = F.when((F.col("ca") > 5) & (F.col("ce") > 5), "god").when((F.col("ce") == 0) & (F.col("ca") > 0), "leaf").otherwise("plain")
    return j.select("module", "ca", "ce", F.round(i, 6).alias("instability"), F.round(F.abs(i + a - 1), 6).alias("distance"), kind.alias("kind"), *([F.round(a, 6).alias("abstractness")] if isinstance(abstractness, DataFrame) else []))


def module_edges(edges: DataFrame, module: DataFrame) -> DataFrame:
    m = module.select("node", "module")
    j = edges.join(m.select(F.col("node").alias("src"), F.col("module").alias("a")), "src").join(m.select(F.col("node").alias("dst"), F.col("module").alias("b")), "dst")
    return j.groupBy("a", "b").agg(F.count("*").alias("links"))


def mermaid_lines(module_edge_rows: DataFrame) -> DataFrame:
    """module, line: the links from each module in Mermaid notation, a row each."""
    ident = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    line = F.concat(F.lit("  "), ident(F.col("a")), F.lit(" -->|"), F.col("links").cast("string"), F.lit("| "), ident(F.col("b")))
    return module_edge_rows.select(F.col("a").alias("module"), line.alias("line"))


def mermaid(module_edge_rows: DataFrame) -> DataFrame:
    """One row, text: the module graph in Mermaid notation, lines in order. For graphs that people look at; of one too large
    for a row take mermaid_lines."""
    return mermaid_lines(module_edge_rows).agg(F.concat_ws("\n", F.lit("graph TD"), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("text"))


def first_layer(paths: DataFrame, layers: list[tuple[str, int, list[str]]]) -> DataFrame:
    """node, layer, layer_order: the first layer (by order) of which a pattern (regular expression) fits the path."""
    pick = F.lit(None).cast("string")
    order = F.lit(None).cast("int")
    for name, n, patterns in sorted(layers, key=lambda x: -x[1]):
        fits = F.lit(False)
        for p in patterns:
            fits = fits | F.col("path").rlike(p)
        pick, order = F.when(fits, name).otherwise(pick), F.when(fits, n).otherwise(order)
    return paths.select("node", "path", pick.alias("layer"), order.cast("int").alias("layer_order"))


def layer_violations(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per file: layers that it reaches down into (their order is above its own), and the worst severity."""
    a = assigned.where("layer is not null")
    j = edges.join(a.select(F.col("node").alias("src"), F.col("layer").alias("l1"), F.col("layer_order").alias("o1")), "src").join(a.select(F.col("node").alias("dst"), F.col("layer").alias("l2"), F.col("layer_order").alias("o2")), "dst")
    v = j.where("o2 > o1")
    return v.groupBy("src", "l1").agg(F.count("*").alias("imports"), F.array_join(F.array_sort(F.collect_set("l2")), ",").alias("layers"), F.when(F.bool_or(F.expr("o2 - o1 > 1")), "error").otherwise("warning").alias("severity"))
