"""Reports over files: sizes, modules, languages, coverage, hotspots, health, churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import module_of
from ..functions.scalars import clamp01, genome_label, half_up


def _size() -> Column:
    return F.coalesce("size_bytes", F.lit(0))


def _load() -> Column:
    return F.coalesce("cognitive_load", F.lit(0.0))


def _touched() -> Column:
    return F.coalesce("agent_touched", F.lit(False))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def scale_report(files: DataFrame) -> DataFrame:
    """One row of totals; lines are estimated from bytes. Null sizes and loads count as nothing; an empty table gives zeros."""
    return files.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum(_size()), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.coalesce(F.sum(half_up(_size() / 20)), F.lit(0)).cast("bigint").alias("estimated_lines"),
        F.round(share(F.sum(_load()), F.greatest(F.count("*"), F.lit(1))), 6).alias("average_load"),
        F.round(share(F.count_if(_touched()), F.greatest(F.count("*"), F.lit(1))), 6).alias("agent_coverage"),
    )


def language_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"), F.sum(_size()).cast("bigint").alias("bytes"))


def module_rollup(files: DataFrame) -> DataFrame:
    g = files.groupBy("project_id", module_of(F.col("relative_path")).alias("module"))
    return g.agg(F.count("*").alias("files"), F.sum(_size()).cast("bigint").alias("bytes"), F.round(F.sum(_load()), 4).alias("load"), F.round(F.avg(_touched().cast("int")), 6).alias("coverage"))


def hotspots(files: DataFrame, n: int = 10) -> DataFrame:
    return files.select("id", "relative_path", _load().alias("load")).orderBy(F.desc("load"), "id").limit(n)


def uncovered(files: DataFrame, n: int = 10) -> DataFrame:
    return hotspots(files.where(~_touched()), n)


def uncovered_modules(files: DataFrame) -> DataFrame:
    return module_rollup(files).where("coverage = 0")


def high_load_modules(files: DataFrame, threshold: float = 0.5) -> DataFrame:
    return module_rollup(files).where(F.col("load") > threshold)


def module_info(files: DataFrame, prefix: str) -> DataFrame:
    """Totals of the files below a path prefix."""
    return scale_report(files.where(F.startswith("relative_path", F.lit(prefix)))).withColumn("module", F.lit(prefix))


def coverage_heatmap(files: DataFrame) -> DataFrame:
    return files.select("id", "relative_path", _touched().alias("covered"), _load().alias("load"))


def agent_profiles(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """agent, sessions, first and last, files touched: sessions (agent, started_at) grouped, then joined with touches grouped."""
    s = sessions.groupBy("agent").agg(F.count("*").alias("sessions"), F.min("started_at").alias("first_seen"), F.max("started_at").alias("last_seen"))
    t = files.where(_touched() & F.col("agent_touched_by").isNotNull()).groupBy(F.col("agent_touched_by").alias("agent")).agg(F.count("*").alias("touched"))
    return s.join(t, "agent", "full_outer").select("agent", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("touched", F.lit(0)).alias("touched"), "first_seen", "last_seen")


def churn(files: DataFrame, touches: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Risk of every file from its touches (file_id, ts) in the window and its load; files of no churn and risk drop out."""
    recent = touches.where((F.col("ts") <= as_of) & (F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))).groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("churn"))
    f = files.join(recent, "id", "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    risk = F.least(F.col("churn") / 20, F.lit(1.0)) * 0.6 + F.least(_load() / 0.5, F.lit(1.0)) * 0.4
    return f.withColumn("risk", F.round(risk, 6)).where("churn > 0 or risk > 0.1").select("id", "relative_path", "agent_touched_by", "churn", "risk")


def churn_by(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("files"), F.sum("churn").cast("bigint").alias("churn"), F.round(F.sum("risk"), 4).alias("risk"), F.round(F.avg("risk"), 4).alias("average_risk"))


def genome(pattern_confidence: DataFrame, open_high: DataFrame, cycles: DataFrame, import_stats: DataFrame, sessions: DataFrame) -> DataFrame:
    """The coherence score, from five frames of one row: (weighted, average), (n), (n), (rate), (n)."""
    one = pattern_confidence.crossJoin(open_high.select(F.col("n").alias("high"))).crossJoin(cycles.select(F.col("n").alias("cycles"))).crossJoin(import_stats.select("rate")).crossJoin(sessions.select(F.col("n").alias("sessions")))
    score = F.col("weighted") * 0.7 + F.col("average") * 0.3 - F.least(F.col("high") * 0.02, F.lit(0.3)) - F.least(F.col("cycles") * 0.05, F.lit(0.2)) + F.col("rate") * 0.05 + F.least(F.col("sessions") / 10, F.lit(1.0)) * 0.05
    s = F.round(clamp01(score), 4)
    return one.select(s.alias("score"), genome_label(s).alias("label"), "high", "cycles", F.round("rate", 4).alias("import_rate"), "sessions")


def health(files: DataFrame, genome_score: DataFrame) -> DataFrame:
    r = scale_report(files).crossJoin(genome_score.select("score", "high"))
    status = F.when(F.col("high") > 0, "unhealthy").when((F.col("agent_coverage") == 0) | (F.col("average_load") >= 0.5) | (F.col("score") <= 0.7), "degraded").otherwise("healthy")
    return r.select(status.alias("status"), "total_files", "agent_coverage", "average_load", "score", "high")


def relevance(files: DataFrame, task: str) -> DataFrame:
    """How much each file matters for a task in words, and its cost in tokens."""
    words = [w for w in task.lower().split() if len(w) > 2]
    rel = F.lower("relative_path")
    name = F.lower(F.element_at(F.split("relative_path", "/"), -1))
    hit = F.lit(False)
    score = F.lit(0.0)
    for w in words:
        hit = hit | F.contains(name, F.lit(w))
        score = score + F.when(F.contains(rel, F.lit(w)), 0.3).otherwise(0.0)
    base = (F.when(hit, 0.8).otherwise(0.0) + score + F.when(_touched(), 0.2).otherwise(0.0) - _load() * 0.3) if words else F.lit(0.5)
    r = F.round(clamp01(base), 6)
    return files.select("id", "project_id", "relative_path", r.alias("relevance"), F.round(r * (1 - F.least(_load(), F.lit(1.0))), 6).alias("priority"), F.ceil(_size() / 4).cast("bigint").alias("tokens"))


#: Ways to rank files for a budget, greatest first.
STRATEGIES = ("relevance", "diversity", "coverage", "hybrid")


def budget_report(scored: DataFrame, budget: int, strategy: str) -> DataFrame:
    """strategy, project_id, candidates, selected, used, utilization, recommendations of the greedy choice by a strategy."""
    order = {"relevance": F.col("relevance"), "diversity": F.col("priority"), "coverage": F.col("tokens").cast("double"), "hybrid": F.col("relevance") * 0.6 + F.col("priority") * 0.4}[strategy]
    chosen = context_budget(scored.withColumn("_order", order), budget, "_order").groupBy("project_id").agg(F.count("*").alias("selected"), F.max("used").alias("used"))
    all_of = scored.groupBy("project_id").agg(F.count("*").alias("candidates"), F.bool_or(F.col("tokens") > budget * 0.5).alias("large"))
    j = all_of.join(chosen, "project_id", "left").na.fill(0, ["selected", "used"])
    share = F.col("used") / budget
    notes = F.array_compact(F.array(F.when(share < 0.5, "underutilized"), F.when(share > 0.95, "exhausted"), F.when((F.col("selected") < 5) & (F.col("candidates") > 10), "few-selected"), F.when(F.col("large"), "large-files")))
    return j.select(F.lit(strategy).alias("strategy"), "project_id", "candidates", "selected", "used", F.round(share, 4).alias("utilization"), F.array_join(notes, ",").alias("recommendations"))


def names_meet(path: Column, name: str) -> Column:
    """Whether one of the two is part of the other."""
    return F.contains(path, F.lit(name)) | F.contains(F.lit(name), path)


def context_budget(scored: DataFrame, budget: int, order: str = "priority") -> DataFrame:
    """Greedy choice within a token budget: down the ranking, what does not fit is skipped and the next is tried.

    Every file is considered. Files of no tokens always fit and need no fold. What is used only grows, so once a file of
    t tokens is skipped no later one of t tokens fits: of the files of t tokens the first ones down the ranking are
    chosen, budget / t of them at most. No others reach the fold, which sees some budget * ln(budget) files of a
    project, whatever its size, and the choice is that of a fold over all. tokens: not negative; null never fits.
    """
    from pyspark.sql import Window

    fit = scored.where(F.col("tokens") <= budget)
    nth = F.row_number().over(Window.partitionBy("project_id", "tokens").orderBy(F.desc(order), "id"))
    first = fit.where("tokens > 0").withColumn("nth", nth).where(F.col("nth") * F.col("tokens") <= budget)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc(order), "id")))
    rows = ranked.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "tokens"))).alias("rows"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    step = lambda a, r: F.when(a["used"] + r["tokens"] <= budget, F.struct((a["used"] + r["tokens"]).alias("used"), F.concat(a["ids"], F.array(r["id"])).alias("ids"))).otherwise(a)
    chosen = rows.select("project_id", F.aggregate("rows", start, step).alias("r")).select("project_id", "r.used", "r.ids")
    free = fit.where("tokens = 0").select("project_id", "id").join(chosen.select(F.col("project_id").alias("p"), "used"), F.col("project_id").eqNullSafe(F.col("p")), "left")
    return chosen.select("project_id", "used", F.explode("ids").alias("id")).unionByName(free.select("project_id", F.coalesce("used", F.lit(0).cast("bigint")).alias("used"), "id"))
