"""References to records that do not exist.

Parents are validity intervals [valid_from, valid_to) of a key, as many as there are. References and the starts and ends
of intervals are put together, cut into ranges of (key, time) and merged in one pass in that order: the number of
intervals that are open, and whether there were any before, say what a reference meets. A range is cut anywhere, in the
middle of a hot key too; what is open where a range begins is carried over in a table of at most two rows a range.

A reference that meets no open interval is `missing` (no interval of its key at all), `late` (before every interval: the
record came later) or `deleted` (after one had ended, whether or not another begins afterwards).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dirname, fold, slashes
from ..session import cut, release

#: Suffixes an import may leave out (fixed values of the task).
IMPORT_SUFFIXES = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def _first() -> Column:
    """The time before all others."""
    return F.lit("0001-01-01").cast("timestamp_ntz")


def orphans(refs: DataFrame, parents: DataFrame, key: list[str] | str, at: str, carry: list[str]) -> DataFrame:
    """References without a parent that is valid at their time.

    refs: key, at and carry; parents: key, valid_from (null: from ever), valid_to (null: open end), any number of rows a
    key, which may repeat, touch, overlap or leave gaps. Result: carry, at and reason. A null key is a reference to
    nothing: `missing`. A null time is compared with nothing, so only `missing` can come out. An interval that ends before
    it begins, or where it begins, is never open; a reference after its end is `deleted`.
    """
    keys = [key] if isinstance(key, str) else list(key)
    out = list(dict.fromkeys([*carry, at]))
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    start, end = F.coalesce("valid_from", _first()), F.col("valid_to")
    delta = F.when(end <= start, 0).otherwise(1)
    marks = F.array(F.struct(start.alias("_at"), delta.alias("_delta")), F.struct(end.alias("_at"), (-delta).alias("_delta")))
    marks = parents.where(~no_key).select(*keys, F.explode(marks).alias("m")).where("m._at is not null").select(*keys, "m._at", F.lit(0).alias("_kind"), "m._delta", F.lit(1).alias("_past"))
    rows = refs.where(~no_key).select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_delta"), F.lit(0).alias("_past"), F.struct(*out).alias("_row"))
    # Written once: ranges are found by a look at all rows, which would work out references and parents twice.
    both = cut(marks.unionByName(rows, allowMissingColumns=True))
    # References of one time may be parted too, so that no range has to hold more than its share.
    placed = cut(both.repartitionByRange(*keys, "_at", "_kind", F.xxhash64("_row")).withColumn("_range", F.spark_partition_id()))
    release(both)

    # Only the first and the last key of a range can reach into others.
    edge = F.struct(*keys)
    edges = placed.groupBy("_range").agg(F.array(F.min(edge), F.max(edge)).alias("e")).select(F.explode("e").alias("e")).select("e.*").distinct()
    parts = placed.join(F.broadcast(edges), keys, "left_semi").groupBy("_range", *keys).agg(F.sum("_delta").alias("delta"), F.sum("_past").alias("past"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_range", *keys, F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("_open0"), F.coalesce(F.sum("past").over(before), F.lit(0)).alias("_past0"), F.sum("past").over(Window.partitionBy(*keys)).alias("_all0"))

    so_far = Window.partitionBy("_range", *keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = placed.select("*", F.sum("_delta").over(so_far).alias("_open"), F.sum("_past").over(so_far).alias("_ended"), F.sum("_past").over(Window.partitionBy("_range", *keys)).alias("_all"))
    merged = merged.where("_kind = 1").join(F.broadcast(carried), ["_range", *keys], "left")
    total = lambda own, other: F.col(own) + F.coalesce(other, F.lit(0))
    known = F.greatest(F.col("_all"), F.coalesce("_all0", F.lit(0)))
    reason = F.when(known == 0, "missing").when(F.col("_at").isNull() | (total("_open", "_open0") > 0), None).when(total("_ended", "_past0") > 0, "deleted").otherwise("late")
    got = cut(merged.select("_row.*", reason.alias("reason")).where("reason is not null"))
    release(placed)
    return got.unionByName(refs.where(no_key).select(*out, F.lit("missing").alias("reason")))


def file_states(files: DataFrame, deletions: DataFrame) -> DataFrame:
    """One row per file: id, project_id, relative_path of the current row, first_scan, last_scan, and deleted_from: the
    latest deletion, if it is not before the latest scan."""
    order = F.struct(F.coalesce("last_scanned", F.lit("0001-01-01").cast("timestamp_ntz")), F.col("hash"))
    f = files.where("id is not null").groupBy("id").agg(F.max_by(F.struct("project_id", "relative_path"), order).alias("r"), F.min("last_scanned").alias("first_scan"), F.max("last_scanned").alias("last_scan"))
    d = deletions.where("entity = 'file'").groupBy(F.col("entity_id").alias("id")).agg(F.max("deleted_at").alias("del"))
    return f.join(d, "id", "left").select("id", "r.project_id", "r.relative_path", "first_scan", "last_scan", F.when(F.col("del") >= F.col("last_scan"), F.col("del")).alias("deleted_from"))


def call_references(calls: DataFrame, functions: DataFrame, states: DataFrame, deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (ref_id, id, moment) and the intervals of the functions that they may point to (id, valid_from, valid_to): from
    the first scan of a function's file to the deletion of the function or its file."""
    gone = deletions.where("entity = 'function'").groupBy(F.col("entity_id").alias("id")).agg(F.min("deleted_at").alias("gone"))
    fn = functions.where("id is not null").groupBy("id").agg(F.min("file_id").alias("file_id")).join(gone, "id", "left")
    s = states.select(F.col("id").alias("file_id"), "first_scan", "deleted_from")
    parents = fn.join(s, "file_id", "left").select("id", F.col("first_scan").alias("valid_from"), F.least("gone", "deleted_from").alias("valid_to"))
    return calls.select(F.col("id").alias("ref_id"), F.col("to_function_id").alias("id"), F.col("detected_at").alias("moment")), parents


def file_keys(states: DataFrame) -> DataFrame:
    """The import paths by which each file can be reached: (project_id, target). Turning the rule round, from the file to
    the paths that lead to it, leaves one row per import instead of one per import and candidate."""
    path = fold(F.col("relative_path"))
    ext = "(" + "|".join(IMPORT_SUFFIXES) + ")"
    hit = path.rlike(rf"\.{ext}$")
    keys = F.array_compact(F.array(
        path,
        F.when(hit, F.regexp_replace(path, rf"\.{ext}$", "")),
        F.when(path.rlike(rf"(^|/)index\.{ext}$"), F.regexp_replace(path, rf"(^|/)index\.{ext}$", "")),
        F.when(path.endswith(".ts"), F.regexp_replace(path, r"\.ts$", ".js")),
        F.when(path.endswith(".tsx"), F.regexp_replace(path, r"\.tsx$", ".jsx")),
    ))
    return states.select("project_id", F.explode(keys).alias("target"), "deleted_from")


def import_targets(imports: DataFrame, states: DataFrame) -> DataFrame:
    """Imports that point to a path within their project: ref_id, project_id, target (null if it leaves the project), at."""
    s = states.select(F.col("id").alias("file_id"), "project_id", F.col("relative_path").alias("_rel"), F.col("last_scan").alias("at"))
    relative = F.col("source").startswith(".")
    i = imports.where(F.col("resolved_path").isNotNull() | relative).select(F.col("id").alias("ref_id"), "file_id", "source", "resolved_path").join(s, "file_id", "left")
    raw = F.when(F.col("resolved_path").isNotNull(), F.col("resolved_path")).otherwise(F.concat_ws("/", dirname(slashes(F.col("_rel"))), F.col("source")))
    return i.select("ref_id", "project_id", fold(raw).alias("target"), "at")


def import_references(imports: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports (ref_id, id of the project, target, moment) and the intervals of the paths that they may point to (id, target,
    valid_from, valid_to). A file is there at any time or, once deleted, at none, whenever the import was recorded."""
    gone = F.when(F.col("deleted_from").isNotNull(), _first())
    parents = file_keys(states).select(F.col("project_id").alias("id"), "target", F.lit(None).cast("timestamp_ntz").alias("valid_from"), gone.alias("valid_to"))
    return import_targets(imports, states).select("ref_id", F.col("project_id").alias("id"), "target", F.col("at").alias("moment")), parents


def dangling(files: DataFrame, functions: DataFrame, imports: DataFrame, calls: DataFrame, deletions: DataFrame) -> DataFrame:
    """All dangling rows: ref_table, ref_id, month ('yyyy-MM'), reason; copies of a row count once. Calls and imports go
    through one merge: their keys are (table, id of function or project, path)."""
    states = file_states(files, deletions)
    c, functions_at = call_references(calls, functions, states, deletions)
    i, paths_at = import_references(imports, states)
    of = lambda df, name: df.withColumn("ref_table", F.lit(name))
    path = F.lit("").alias("target")
    refs = of(c.select("*", path, F.col("moment").alias("at")), "calls").unionByName(of(i.withColumn("at", F.lit("2000-01-01").cast("timestamp_ntz")), "imports"))
    parents = of(functions_at.select("*", path), "calls").unionByName(of(paths_at, "imports"))
    got = orphans(refs, parents, ["ref_table", "id", "target"], "at", ["ref_table", "ref_id", "moment"])
    return got.where("ref_id is not null").groupBy("ref_table", "ref_id").agg(F.min(F.date_format("moment", "yyyy-MM")).alias("month"), F.min("reason").alias("reason"))
