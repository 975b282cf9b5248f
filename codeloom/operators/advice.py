"""Findings about files, put together from rules: suggestions, candidates for refactoring, previews of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_up

PRIORITIES = ("high", "medium", "low")


def priority_order(priority: Column) -> Column:
    """0 for high, 1 for medium, 2 for low, 3 for any other."""
    out = F.lit(len(PRIORITIES))
    for n, p in reversed(list(enumerate(PRIORITIES))):
        out = F.when(priority == p, n).otherwise(out)
    return out


def plain_signature(signature: Column) -> Column:
    """A signature as it is compared: blanks folded; a null one is empty."""
    return F.trim(F.regexp_replace(F.coalesce(signature, F.lit("")), r"\s+", " "))


def repeated_signatures(functions: DataFrame) -> DataFrame:
    """file_id, signature, repeats: signatures that stand in a file more than once, with how often beyond the first. Counted
    before any shuffle. functions: id, file_id, signature; copies of a row count once."""
    f = functions.select("id", "file_id", plain_signature(F.col("signature")).alias("signature")).distinct()
    return f.groupBy("file_id", "signature").agg((F.count("*") - 1).alias("repeats")).where("repeats > 0")


def suggestions(files: DataFrame, functions: DataFrame, imports: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """file_id, type, priority, subject, amount, rank (0 first): what a reader of each file is advised to look at.

    files: id, cognitive_load, agent_touched; functions: id, file_id, name, signature, complexity; imports: id, file_id,
    source, resolved_id; classes: file_id, name, methods. A function that other files have under the same name with
    another signature is one suggestion, with the number of such files, not one for each of them.
    """
    row = lambda kind, priority, subject, amount: (F.lit(kind).alias("type"), priority.alias("priority") if isinstance(priority, Column) else F.lit(priority).alias("priority"), subject.cast("string").alias("subject"), amount.cast("double").alias("amount"))
    f = functions.select("id", "file_id", "name", plain_signature(F.col("signature")).alias("signature"), "complexity").distinct()
    none = F.lit(None)
    parts = [f.where("complexity > 10").select("file_id", *row("complexity", F.when(F.col("complexity") > 20, "high").otherwise("medium"), F.col("name"), F.col("complexity")))]
    own = files.withColumnRenamed("id", "file_id")
    parts.append(own.where("cognitive_load > 0.7").select("file_id", *row("complexity", "high", none, F.col("cognitive_load"))))
    parts.append(repeated_signatures(functions).select("file_id", *row("duplication", "medium", F.col("signature"), F.col("repeats"))))
    parts.append(_other_files(f.where("name is not null and file_id is not null").select("name", "signature", "file_id").distinct()).where("others > 0").select("file_id", *row("duplication", "low", F.col("name"), F.col("others"))))
    i = imports.select("id", "file_id", "source", "resolved_id").distinct().groupBy("file_id").agg(F.count_if(F.col("resolved_id").isNull()).alias("external"), F.count_if(F.contains("source", F.lit("../"))).alias("up"))
    parts.append(i.where("external > 10").select("file_id", *row("architecture", "medium", none, F.col("external"))))
    parts.append(i.where("up > 3").select("file_id", *row("architecture", "low", none, F.col("up"))))
    if classes is not None:
        parts.append(classes.where("methods > 15").select("file_id", *row("performance", "medium", F.col("name"), F.col("methods"))))
    parts.append(own.where(~F.coalesce("agent_touched", F.lit(False))).select("file_id", *row("consistency", "low", none, none)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rank", priority_order(F.col("priority")))


def _other_files(every: DataFrame) -> DataFrame:
    """name, signature, file_id, others: the other files in which the name has a signature that is not this one (a file that
    has both counts too). Worked out from counts, without pairs of files."""
    per_file = every.groupBy("name", "file_id").agg(F.count("*").alias("in_file"))
    files = per_file.groupBy("name").agg(F.count("*").alias("files"))
    alone = per_file.where("in_file = 1").select("name", "file_id", F.lit(1).alias("alone"))
    only = every.join(alone, ["name", "file_id"]).groupBy("name", "signature").agg(F.count("*").alias("only_it"))
    j = every.join(files, "name").join(only, ["name", "signature"], "left").join(alone, ["name", "file_id"], "left")
    # All files of the name, less those that have this signature alone; this file itself is none of the others.
    others = F.col("files") - F.coalesce("only_it", F.lit(0)) - F.when(F.col("alone").isNull(), 1).otherwise(0)
    return j.select("name", "signature", "file_id", others.alias("others"))


#: How much risk each kind of refactoring takes away.
REDUCTION = {"extract-function": 0.3, "extract-class": 0.4, "simplify": 0.35, "rename": 0.25, "move": 0.3, "inline": 0.15}


def refactor_candidates(files: DataFrame, debts: DataFrame) -> DataFrame:
    """id, kind, effort, roi, priority of the six kinds of candidates. files: id, lines, cognitive_load, churn, imports;
    debts: file_id, redundancy, drift, items (counts of open items). Return: risk taken away times churn by effort in hours.
    Files without debt and of a load below 0.2 are left out."""
    load, lines, churn = F.coalesce("cognitive_load", F.lit(0.0)), F.coalesce("lines", F.lit(0)), F.coalesce("churn", F.lit(0))
    n = lambda c: F.coalesce(c, F.lit(0))
    f = files.join(debts.withColumnRenamed("file_id", "id"), "id", "left").where((n("items") > 0) | (load >= 0.2))
    one = lambda kind, effort: F.struct(F.lit(kind).alias("kind"), effort.cast("double").alias("effort"), F.lit(REDUCTION[kind]).alias("reduction"))
    rules = F.array_compact(F.array(
        F.when((load > 0.5) | (lines > 300), one("extract-function", F.least(lines / 50, F.lit(8.0)))),
        F.when((load > 0.7) & (lines > 500), one("extract-class", F.least(lines / 100, F.lit(16.0)))),
        F.when(n("redundancy") > 0, one("simplify", F.least(n("redundancy") * 2, F.lit(8)))),
        F.when(n("drift") > 0, one("rename", F.least(n("drift"), F.lit(4)))),
        F.when((churn > 5) & (load > 0.3), one("move", F.lit(4))),
        F.when((lines < 50) & (n("imports") > 5), one("inline", F.lit(2))),
    ))
    u = f.select("id", churn.alias("churn"), F.explode(rules).alias("r")).select("id", "r.kind", "r.effort", (F.col("r.reduction") * F.col("churn") / F.nullif(F.col("r.effort"), F.lit(0.0))).alias("raw"))
    raw = F.coalesce("raw", F.lit(0.0))
    priority = F.when(raw > 3, "critical").when(raw > 1.5, "high").when(raw > 0.8, "medium").otherwise("low")
    return u.select("id", "kind", half_up(F.col("effort"), 1).alias("effort"), half_up(raw, 2).alias("roi"), priority.alias("priority"))


def roi_summary(candidates: DataFrame) -> DataFrame:
    """One row: candidates, effort, average return, and how many of each priority."""
    count = lambda p: F.count_if(F.col("priority") == p).alias(p)
    return candidates.agg(F.count("*").alias("candidates"), F.round(F.sum("effort"), 1).alias("effort"), F.round(F.coalesce(F.avg("roi"), F.lit(0.0)), 4).alias("average_roi"), *[count(p) for p in ("critical", "high", "medium", "low")])


def tests_for(changed: DataFrame, files: DataFrame) -> DataFrame:
    """module, test: the tests to run for changed files (module, relative_path): that which stands for the file by its name,
    and all tests of its module; each once. files: module, relative_path."""
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace("relative_path", "src/", "tests/"), r"\.ts$", ".test.ts"), r"\.js$", ".test.js")
    here = files.where(F.col("relative_path").contains(".test.") | F.col("relative_path").contains(".spec."))
    near = here.join(changed.select("module").distinct(), "module", "left_semi").select("module", F.col("relative_path").alias("test"))
    return changed.select("module", named.alias("test")).unionByName(near).distinct()


def breaking_changes(changed: DataFrame) -> DataFrame:
    """relative_path, reason of changed files (relative_path, agent_touched) that others may depend on; each once."""
    p = F.col("relative_path")
    reasons = F.array_compact(F.array(F.when(F.coalesce("agent_touched", F.lit(False)), "public-api"), F.when(p.contains("index.ts") | p.contains("types.ts") | p.contains("contracts"), "core-types")))
    return changed.select("relative_path", F.explode(reasons).alias("reason")).distinct()
