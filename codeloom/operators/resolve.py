"""Imports to files: prioritised candidates as one equi-join.

The rule lists, for an import path, the file names to try in turn. Turned round it lists, for a file, the import paths
that would find it, each with its place in that order; so one row per import meets a few rows per file, and the best
place wins in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname, fold, slashes
from .references import IMPORT_SUFFIXES, import_targets


def candidates(files: DataFrame) -> DataFrame:
    """project_id, target, place, file_id for files (id, project_id, relative_path)."""
    f = files.select("project_id", F.col("id").alias("file_id"), fold(F.col("relative_path")).alias("p"))
    f = f.withColumn("suffix", F.regexp_extract("p", r"\.(" + "|".join(IMPORT_SUFFIXES) + r")$", 1))
    stem = F.substr("p", F.lit(1), F.length("p") - F.length("suffix") - 1)
    f = f.withColumn("stem", F.when(F.col("suffix") != "", stem)).withColumn("n", F.array_position(F.array(*[F.lit(x) for x in IMPORT_SUFFIXES]), F.col("suffix")).cast("int") - 1)
    way = lambda target, place: F.struct(target.alias("target"), place.cast("int").alias("place"))
    stem, n, suffix = F.col("stem"), F.col("n"), F.col("suffix")
    index = F.when(stem == "index", F.lit("")).when(stem.endswith("/index"), F.substr(stem, F.lit(1), F.length(stem) - 6))
    tries = F.array(
        way(F.col("p"), F.lit(0)),
        F.when(suffix == "ts", way(F.concat(stem, F.lit(".js")), F.lit(1))),
        F.when(suffix == "tsx", way(F.concat(stem, F.lit(".jsx")), F.lit(2))),
        F.when(stem.isNotNull(), way(stem, n + 3)),
        F.when(index.isNotNull(), way(index, n + 9)),
    )
    return f.select("project_id", "file_id", F.explode(F.array_compact(tries)).alias("c")).select("project_id", "c.target", "c.place", "file_id")


def resolve_imports(imports: DataFrame, states: DataFrame) -> DataFrame:
    """ref_id, file_id (the importing file), target, resolved_id: the file that each import finds, null if none.

    Ties of place (copies of a path) go to the smallest file id; imports that name a package have no target.
    """
    own = imports.select(F.col("id").alias("ref_id"), F.col("file_id").alias("src")).distinct()
    t = import_targets(imports, states).select("ref_id", "project_id", "target").distinct()
    hit = t.join(candidates(states), ["project_id", "target"]).groupBy("ref_id").agg(F.min(F.struct("place", "file_id")).alias("best"))
    return own.join(t.select("ref_id", "target"), "ref_id", "left").join(hit, "ref_id", "left").select("ref_id", F.col("src").alias("file_id"), "target", F.col("best.file_id").alias("resolved_id"))


def apply_aliases(source: F.Column, aliases: list[tuple[str, str]]) -> F.Column:
    """The source with the first alias prefix that it has replaced by its path (aliases are a handful of settings)."""
    out = source
    for prefix, path in reversed(aliases):
        out = F.when(source.startswith(prefix), F.concat(F.lit(path), F.substr(source, F.lit(len(prefix) + 1)))).otherwise(out)
    return out


def with_aliases(imports: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """imports with resolved_path set to where an alias leads, for sources that begin with one and have no path yet."""
    fits = F.lit(False)
    for prefix, _ in aliases:
        fits = fits | F.col("source").startswith(prefix)
    path = F.coalesce("resolved_path", F.when(fits, apply_aliases(F.col("source"), aliases)))
    return imports.withColumn("resolved_path", path)


def resolve_anyhow(refs: DataFrame, states: DataFrame, aliases: list[tuple[str, str]] = []) -> DataFrame:  # noqa: B006
    """ref_id, resolved_id, way of refs (ref_id, file_id, source): a source is tried as a path from the root of the project
    first (`bare`), then from the directory of its file (`relative`), with all suffixes; null if neither finds a file."""
    s = states.select(F.col("id").alias("file_id"), "project_id", F.col("relative_path").alias("_rel"))
    r = refs.select("ref_id", "file_id", apply_aliases(F.col("source"), aliases).alias("source")).distinct().join(s, "file_id", "left")
    ways = F.array(
        F.struct(F.lit("bare").alias("way"), F.lit(0).alias("first"), fold(F.col("source")).alias("target")),
        F.struct(F.lit("relative").alias("way"), F.lit(1).alias("first"), fold(F.concat_ws("/", dirname(slashes(F.col("_rel"))), F.col("source"))).alias("target")),
    )
    t = r.select("ref_id", "project_id", F.explode(ways).alias("w")).select("ref_id", "project_id", "w.*").where("target is not null and project_id is not null")
    hit = t.join(candidates(states), ["project_id", "target"]).groupBy("ref_id").agg(F.min(F.struct("first", "place", "file_id", "way")).alias("best"))
    return r.select("ref_id").distinct().join(hit, "ref_id", "left").select("ref_id", F.col("best.file_id").alias("resolved_id"), F.col("best.way").alias("way"))


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct (src, dst) of resolved imports."""
    return resolved.where("resolved_id is not null and file_id is not null").select(F.col("file_id").alias("src"), F.col("resolved_id").alias("dst")).distinct()
