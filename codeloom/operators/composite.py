"""Reports that put several operators together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import naming_convention


def _max(c: Column, least: float, when: Column) -> Column:
    return F.when(when, F.greatest(c, F.lit(least))).otherwise(c)


def extract_patterns(files: DataFrame, functions: DataFrame, imports: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """file_id, category, name, confidence: naming of each function, import style, structure and complexity of each file.

    files: id, lines; functions: file_id, name; imports: file_id, source; classes: file_id.
    """
    names = functions.where("name is not null and name <> 'anonymous'").select("file_id", F.lit("naming").alias("category"), "name", F.when(naming_convention(F.col("name")) == "unknown", 0.5).when(naming_convention(F.col("name")).isin("camelCase", "PascalCase"), 0.9).otherwise(0.85).alias("confidence"))
    src = F.col("source")
    alias = src.startswith("@/") | src.startswith("#")
    i = imports.groupBy("file_id").agg(F.bool_or(src.startswith(".")).alias("rel"), F.bool_or(alias).alias("abs"), F.bool_or(src.startswith("node:")).alias("node"), F.bool_or(~src.startswith(".") & ~alias & ~src.startswith("node:")).alias("ext"), F.count("*").alias("imports"))
    fn = functions.groupBy("file_id").agg(F.count("*").alias("functions"))
    cl = classes.groupBy("file_id").agg(F.count("*").alias("classes")) if classes is not None else None
    f = files.select(F.col("id").alias("file_id"), "lines").join(i, "file_id", "left").join(fn, "file_id", "left")
    f = (f.join(cl, "file_id", "left") if cl is not None else f.withColumn("classes", F.lit(0))).na.fill(0, ["imports", "functions", "classes"]).na.fill(False, ["rel", "abs", "node", "ext"])
    style = F.when(F.col("abs") & ~F.col("rel"), 0.95).when(F.col("rel") & ~F.col("abs") & ~F.col("ext"), 0.9).otherwise(0.7)
    style = _max(style, 0.9, F.col("node"))
    density = F.col("functions") / F.greatest(F.col("lines"), F.lit(1))
    shape = F.when((F.col("lines") > 50) & (F.col("lines") < 300), 0.8).otherwise(0.6)
    shape = _max(shape, 0.85, (F.col("classes") > 0) & (F.col("functions") > 0))
    shape = _max(shape, 0.8, (density > 0.05) & (density < 0.3))
    shape = _max(shape, 0.85, (F.col("imports") > 0) & (F.col("imports") < 20))
    cx = F.col("functions") + F.col("classes") * 2
    per_file = F.array(
        F.struct(F.lit("imports").alias("category"), F.lit("import_style").alias("name"), style.alias("confidence")),
        F.struct(F.lit("structure").alias("category"), F.lit("structure_profile").alias("name"), shape.alias("confidence")),
        F.struct(F.lit("structure").alias("category"), F.lit("complexity").alias("name"), F.when(cx < 20, 0.9).when(cx < 50, 0.7).otherwise(0.5).alias("confidence")),
    )
    return names.unionByName(f.select("file_id", F.explode(per_file).alias("p")).select("file_id", "p.category", "p.name", "p.confidence"))


def architecture_check(files: DataFrame, unresolved: DataFrame, functions: DataFrame) -> DataFrame:
    """id, issues, warnings, compliant. files: id, cognitive_load, size_bytes, agent_touched; unresolved: file_id, n;
    functions: file_id, complexity."""
    u = unresolved.withColumnRenamed("file_id", "id")
    c = functions.groupBy(F.col("file_id").alias("id")).agg(F.count_if(F.col("complexity") > 10).alias("complex"))
    j = files.join(u, "id", "left").join(c, "id", "left")
    load, size = F.coalesce("cognitive_load", F.lit(0.0)), F.coalesce("size_bytes", F.lit(0))
    issues = F.array_compact(F.array(F.when(F.coalesce("n", F.lit(0)) > 0, "unresolved-imports"), F.when(load > 0.7, "high-load"), F.when(F.coalesce("complex", F.lit(0)) > 0, "complex-functions")))
    warnings = F.array_compact(F.array(F.when((load > 0.4) & (load <= 0.7), "load"), F.when(size > 50_000, "size"), F.when(~F.coalesce("agent_touched", F.lit(False)), "untouched")))
    return j.select("id", F.array_join(issues, ",").alias("issues"), F.array_join(warnings, ",").alias("warnings"), (F.size(issues) == 0).alias("compliant"))


def pr_preview(files: DataFrame, changed: DataFrame, dependents: DataFrame) -> DataFrame:
    """Per project: changed files, their load, files that depend on them, risk and minutes of review.

    files: id, project_id, cognitive_load; changed: id; dependents: node, dependents.
    """
    c = files.join(changed.select("id").distinct(), "id", "left_semi").join(dependents.withColumnRenamed("node", "id"), "id", "left")
    g = c.groupBy("project_id").agg(F.count("*").alias("changed"), F.round(F.max(F.coalesce("cognitive_load", F.lit(0.0))), 6).alias("worst_load"), F.coalesce(F.sum("dependents"), F.lit(0)).cast("bigint").alias("affected"))
    risk = F.when(F.col("worst_load") > 0.5, "high").when(F.col("worst_load") > 0.2, "medium").otherwise("low")
    return g.withColumn("risk", risk).withColumn("minutes", F.greatest(F.lit(10), F.col("changed") * 3 + 2))


def skill_gaps(levels: DataFrame, skills: DataFrame, agents: DataFrame, threshold: float = 0.3) -> DataFrame:
    """agent, skill, gap, priority, hours. levels: agent, skill, level; skills (a list of settings): skill, importance."""
    want = agents.select("agent").distinct().crossJoin(F.broadcast(skills.select("skill", "importance")))
    j = want.join(levels.select("agent", "skill", "level"), ["agent", "skill"], "left")
    gap = F.col("importance") - F.coalesce("level", F.lit(0.0))
    j = j.withColumn("gap", F.round(gap, 6)).where(F.col("gap") >= threshold)
    priority = F.when((F.col("gap") > 0.5) & (F.col("importance") > 0.8), "critical").when(F.col("gap") > 0.4, "high").when(F.col("gap") > 0.25, "medium").otherwise("low")
    return j.select("agent", "skill", "gap", priority.alias("priority"), F.ceil(F.col("gap") * 20).cast("bigint").alias("hours"))
