"""Path expressions, all as Columns, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashes(path: Column) -> Column:
    """Backslashes as slashes."""
    return F.translate(path, "\\", "/")


def fold(path: Column) -> Column:
    """The path without `.`, `..` and doubled slashes; null stays null. A `..` that leaves the root makes the path null:
    nothing inside the project can be meant."""
    parts = F.filter(F.split(slashes(path), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        up, n = part == "..", F.size(acc["kept"])
        kept = F.when(up, F.slice(acc["kept"], F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(F.concat(acc["kept"], F.array(part)))
        return F.struct(kept.alias("kept"), (acc["out"] | (up & (n == 0))).alias("out"))

    end = F.aggregate(parts, start, step)
    plain = F.array_join(parts, "/")
    return F.when(~F.array_contains(parts, ".."), plain).when(~end["out"], F.array_join(end["kept"], "/"))


def dirname(path: Column) -> Column:
    """All before the last slash; empty for a name alone."""
    return F.regexp_extract(slashes(path), r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def extension(path: Column) -> Column:
    """The last suffix without its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.([A-Za-z0-9_+]+)$", 1))


def module_of(relative: Column) -> Column:
    """First segment of the directory, `.` for a file at the root."""
    return F.when(F.contains(slashes(relative), F.lit("/")), F.substring_index(slashes(relative), "/", 1)).otherwise(F.lit("."))


def first_segment(relative: Column) -> Column:
    """First segment of the path itself; the name of the file for one at the root."""
    return F.substring_index(slashes(relative), "/", 1)
