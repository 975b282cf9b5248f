"""Writes to the stored tables, as results: what a table holds afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import resolve_imports
from .upsert import last_write_wins

#: The project that cannot be deleted (a fixed value).
DEFAULT_PROJECT = 1


def lookup_paths(rows: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """rows with file_id: the file whose path is the one given or, if there is none, whose relative path is. Files: id, path,
    relative_path, and project_id if rows have it too: then only files of the same project count. Several files of a path:
    the smallest id. Both lookups are equi-joins with one row a path."""
    by = ["project_id"] if "project_id" in rows.columns else []

    def of(column: str, name: str) -> DataFrame:
        return files.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias(path)).agg(F.min("id").alias(name))

    j = rows.join(of("path", "_exact"), [*by, path], "left").join(of("relative_path", "_relative"), [*by, path], "left")
    return j.select(*rows.columns, F.coalesce("_exact", "_relative").alias("file_id"))


def delete_project(projects: DataFrame, files: DataFrame, project: int) -> tuple[DataFrame, DataFrame]:
    """Projects and files after a project is deleted; the default one cannot be (ValueError)."""
    if project == DEFAULT_PROJECT:
        raise ValueError("the default project cannot be deleted")
    return projects.where(F.col("id") != project), files.where(F.coalesce(F.col("project_id") != project, F.lit(True)))


def mark_touched(files: DataFrame, touches: DataFrame) -> DataFrame:
    """files with agent_touched, agent_touched_by and agent_touched_at set by touches (project_id, path, agent, at, seq): of
    a file, by path or relative path, the last by (at, seq) counts. A touch of no file changes nothing."""
    t = touches.groupBy("project_id", "path").agg(F.max_by(F.struct("agent", "at", "seq"), F.struct("at", "seq")).alias("t"))
    same = lambda c, name: t.select("project_id", F.col("path").alias(c), F.col("t").alias(name))
    j = files.join(same("path", "_a"), ["project_id", "path"], "left").join(same("relative_path", "_b"), ["project_id", "relative_path"], "left")
    order = lambda c: F.struct(F.col(c)["at"], F.col(c)["seq"])
    last = F.when(F.col("_a").isNull() | (F.col("_b").isNotNull() & (order("_b") > order("_a"))), F.col("_b")).otherwise(F.col("_a"))
    j = j.withColumn("_t", last)
    new = {"agent_touched": F.lit(True), "agent_touched_by": F.col("_t.agent"), "agent_touched_at": F.col("_t.at")}
    return j.select(*[F.when(F.col("_t").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in files.columns])


def truncate(table: DataFrame) -> DataFrame:
    """The table without rows."""
    return table.limit(0)


def append(history: DataFrame, rows: DataFrame) -> DataFrame:
    """Both; columns that one lacks are null."""
    return history.unionByName(rows, allowMissingColumns=True)


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows whose keys it does not have, each once (the smallest row); what is there stays."""
    fresh = rows.join(table.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in rows.columns if c not in keys]
    fresh = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]) if rest else fresh.select(*keys).distinct()
    return append(table, fresh)


def ingest_by_name(traces: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, stubs) of traces (from_name, to_name, workload_id, call_count, static_missed, seq) between names. A name that
    no function has becomes a stub, whose id is a hash of it, so any run makes the same; a name that several have stands
    for the smallest id. Edges: the names, the ids at both ends, counts added (null is one), static_missed of the last."""
    known = functions.where("name is not null").groupBy("name").agg(F.min("id").alias("id"))
    e = traces.groupBy("from_name", "to_name", "workload_id").agg(F.sum(F.coalesce("call_count", F.lit(1))).cast("bigint").alias("call_count"), F.max_by("static_missed", "seq").alias("static_missed"))
    for end in ("from", "to"):
        e = e.join(known.select(F.col("name").alias(f"{end}_name"), F.col("id").alias(f"_{end}")), f"{end}_name", "left")
    stub = lambda end: F.col(f"_{end}").isNull()
    e = e.select("from_name", "to_name", "workload_id", "call_count", "static_missed", *[c for end in ("from", "to") for c in (F.coalesce(f"_{end}", F.xxhash64(f"{end}_name")).alias(f"{end}_id"), stub(end).alias(f"{end}_stub"))])
    ends = e.where("from_stub").select(F.col("from_id").alias("id"), F.col("from_name").alias("name")).unionByName(e.where("to_stub").select(F.col("to_id").alias("id"), F.col("to_name").alias("name")))
    return e, ends.where("name is not null").distinct()


def file_details(structures: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions, imports) of parsed files: file_id, functions array<struct>, imports array<struct(id, source,
    resolved_path)>. Imports are resolved as they are written: resolved_id is the file, null for none."""
    functions = structures.select("file_id", F.explode("functions").alias("f")).select("file_id", "f.*")
    imports = structures.select("file_id", F.explode("imports").alias("i")).select("file_id", "i.*")
    found = resolve_imports(imports, states).select(F.col("ref_id").alias("id"), "resolved_id")
    return functions, imports.join(found, "id", "left")


def snapshots(rows: DataFrame, checksum: Column, keys: list[str], at: str) -> DataFrame:
    """One row per keys and checksum, that of the latest time: a snapshot of what was seen before replaces it."""
    return last_write_wins(rows.withColumn("checksum", checksum), [*keys, "checksum"], [at])
