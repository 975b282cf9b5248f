"""Queries of the reports over files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import first_segment
from ..operators import metrics as M
from ..sources.tables import current_files, table
from .registry import core

ALL = ("project_id", "path", "relative_path", "language", "size_bytes", "hash", "last_scanned", "agent_touched", "agent_touched_by", "agent_touched_at", "cognitive_load")

CUR = """cur as (select * from (select *, row_number() over (partition by id order by last_scanned desc nulls last, hash desc nulls last, size_bytes desc nulls last) rn from files where id is not null) where rn = 1)"""
_MOD = "case when contains(relative_path, '/') then split_part(relative_path, '/', 1) else '.' end"


def cur(spark, d, *cols):
    return current_files(table(spark, d, "files"), *(cols or ALL))


@core.add("scale_report", f"with {CUR} select count(*) total_files, cast(coalesce(sum(size_bytes), 0) as bigint) total_bytes, cast(coalesce(sum(floor(coalesce(size_bytes, 0) / 20 + 0.5)), 0) as bigint) estimated_lines, round(sum(coalesce(cognitive_load, 0)) / greatest(count(*), 1), 6) average_load, round(count_if(agent_touched) / greatest(count(*), 1), 6) agent_coverage from cur")
def scale_report(spark, d):
    return M.scale_report(cur(spark, d))


@core.add("language_breakdown", f"with {CUR} select coalesce(language, 'unknown') as language, count(*) files, cast(sum(coalesce(size_bytes, 0)) as bigint) bytes from cur group by 1")
def language_breakdown(spark, d):
    return M.language_breakdown(cur(spark, d))


_ROLL = f"select project_id, {_MOD} as module, count(*) files, cast(sum(coalesce(size_bytes, 0)) as bigint) bytes, round(sum(coalesce(cognitive_load, 0)), 4) load, round(avg(cast(coalesce(agent_touched, false) as int)), 6) coverage from cur group by 1, 2"


@core.add("module_rollup", f"with {CUR} {_ROLL}")
def module_rollup(spark, d):
    return M.module_rollup(cur(spark, d))


@core.add("uncovered_modules", f"with {CUR} select * from ({_ROLL}) where coverage = 0")
def uncovered_modules(spark, d):
    return M.uncovered_modules(cur(spark, d))


@core.add("high_load_modules", f"with {CUR} select * from ({_ROLL}) where load > 0.5")
def high_load_modules(spark, d):
    return M.high_load_modules(cur(spark, d))


@core.add("hotspots_top10", f"with {CUR} select id, relative_path, coalesce(cognitive_load, 0.0) load from cur order by 3 desc, 1 limit 10")
def hotspots_top10(spark, d):
    return M.hotspots(cur(spark, d))


@core.add("uncovered_top10", f"with {CUR} select id, relative_path, coalesce(cognitive_load, 0.0) load from cur where not coalesce(agent_touched, false) order by 3 desc, 1 limit 10")
def uncovered_top10(spark, d):
    return M.uncovered(cur(spark, d))


@core.add("module_info", f"with {CUR} select 'apps/' as module, count(*) total_files, cast(coalesce(sum(size_bytes), 0) as bigint) total_bytes, cast(coalesce(sum(floor(coalesce(size_bytes, 0) / 20 + 0.5)), 0) as bigint) estimated_lines, round(sum(coalesce(cognitive_load, 0)) / greatest(count(*), 1), 6) average_load, round(count_if(agent_touched) / greatest(count(*), 1), 6) agent_coverage from cur where starts_with(relative_path, 'apps/')")
def module_info(spark, d):
    return M.module_info(cur(spark, d), "apps/")


@core.add("coverage_heatmap", f"with {CUR} select id, relative_path, coalesce(agent_touched, false) covered, coalesce(cognitive_load, 0.0) load from cur")
def coverage_heatmap(spark, d):
    return M.coverage_heatmap(cur(spark, d))


@core.add("coverage_by_module", f"with {CUR} select split_part(relative_path, '/', 1) as module, count_if(agent_touched) covered, count(*) files from cur group by 1")
def coverage_by_module(spark, d):
    return cur(spark, d).groupBy(first_segment(F.col("relative_path")).alias("module")).agg(F.count_if("agent_touched").alias("covered"), F.count("*").alias("files"))


@core.add("project_file_counts", f"with {CUR} select p.id, p.name, count(c.id) files from projects p left join cur c on c.project_id = p.id group by 1, 2")
def project_file_counts(spark, d):
    n = cur(spark, d, "project_id").groupBy("project_id").agg(F.count("*").alias("n"))
    p = table(spark, d, "projects").select("id", "name")
    return p.join(n, p.id == n.project_id, "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("files"))


@core.add("file_lookup", f"with {CUR} select id, path, relative_path from cur where relative_path = (select min(relative_path) from cur)")
def file_lookup(spark, d):
    f = cur(spark, d, "path", "relative_path")
    key = f.agg(F.min("relative_path").alias("relative_path"))
    return f.join(F.broadcast(key), "relative_path").select("id", "path", "relative_path")


@core.add("files_by_language", f"with {CUR} select id, relative_path, last_scanned from cur where language = 'python' order by last_scanned desc, id limit 50")
def files_by_language(spark, d):
    return cur(spark, d, "language", "relative_path", "last_scanned").where("language = 'python'").orderBy(F.desc("last_scanned"), "id").limit(50).select("id", "relative_path", "last_scanned")


@core.add("agent_touched", f"with {CUR} select id, agent_touched_by agent, agent_touched_at moment from cur where agent_touched and agent_touched_by like 'agent-%'")
def agent_touched(spark, d):
    return cur(spark, d).where(F.col("agent_touched") & F.col("agent_touched_by").startswith("agent-")).select("id", F.col("agent_touched_by").alias("agent"), F.col("agent_touched_at").alias("moment"))


@core.add("touched_by_agent", f"with {CUR} select agent_touched_by agent, count(*) files, max(agent_touched_at) last_touch from cur where agent_touched group by 1")
def touched_by_agent(spark, d):
    return cur(spark, d).where("agent_touched").groupBy(F.col("agent_touched_by").alias("agent")).agg(F.count("*").alias("files"), F.max("agent_touched_at").alias("last_touch"))


_SESS = "sess as (select 'agent-' || event_type agent, date_trunc('day', ts) started_at from events group by 1, 2, user_id)"


def sessions(spark, d):
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("agent-"), "event_type").alias("agent"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("started_at"), "user_id").distinct()


@core.add("agent_profiles", f"with {CUR}, {_SESS}, s as (select agent, count(*) sessions, min(started_at) first_seen, max(started_at) last_seen from sess group by 1), t as (select agent_touched_by agent, count(*) touched from cur where agent_touched and agent_touched_by is not null group by 1) select coalesce(s.agent, t.agent) agent, coalesce(sessions, 0) sessions, coalesce(touched, 0) touched, cast(first_seen as timestamp) first_seen, cast(last_seen as timestamp) last_seen from s full join t on s.agent = t.agent")
def agent_profiles(spark, d):
    return M.agent_profiles(cur(spark, d), sessions(spark, d))


_CHURN = f"""{CUR}, latest as (select max(ts) m from events), tch as (select f.id, e.ts from events e join cur f on f.id = e.user_id),
rec as (select id, count(*) churn from tch, latest where ts >= m - interval 30 day group by 1),
ch as (select c.id, relative_path, agent_touched_by, coalesce(churn, 0) churn, round(least(coalesce(churn, 0) / 20, 1.0) * 0.6 + least(coalesce(cognitive_load, 0.0) / 0.5, 1.0) * 0.4, 6) risk from cur c left join rec r on r.id = c.id)"""


def _churn(spark, d):
    e = table(spark, d, "events")
    f = cur(spark, d)
    as_of = e.agg(F.max("ts").alias("as_of"))
    t = e.join(F.broadcast(as_of)).select(F.col("user_id").alias("file_id"), "ts", "as_of")
    return M.churn(f, t, F.col("as_of"))


@core.add("churn_top30", f"with {_CHURN} select * from ch where churn > 0 or risk > 0.1 order by risk desc, id limit 30")
def churn_top30(spark, d):
    return _churn(spark, d).orderBy(F.desc("risk"), "id").limit(30)


@core.add("churn_by_author", f"with {_CHURN} select agent_touched_by as key, count(*) files, cast(sum(churn) as bigint) churn, round(sum(risk), 4) risk, round(avg(risk), 4) average_risk from ch where churn > 0 or risk > 0.1 group by 1")
def churn_by_author(spark, d):
    return M.churn_by(_churn(spark, d), F.col("agent_touched_by"))


@core.add("churn_by_module", f"with {_CHURN} select split_part(relative_path, '/', 1) as key, count(*) files, cast(sum(churn) as bigint) churn, round(sum(risk), 4) risk, round(avg(risk), 4) average_risk from ch where churn > 0 or risk > 0.1 group by 1")
def churn_by_module(spark, d):
    return M.churn_by(_churn(spark, d), first_segment(F.col("relative_path")))


_REL = f"""{CUR}, sc as (select id, project_id, relative_path, coalesce(cognitive_load, 0.0) load, cast(ceil(coalesce(size_bytes, 0) / 4) as bigint) tokens,
 round(greatest(0.0, least(1.0, (case when contains(lower(regexp_extract(relative_path, '[^/]*$')), 'trace') or contains(lower(regexp_extract(relative_path, '[^/]*$')), 'cache') then 0.8 else 0 end
 + case when contains(lower(relative_path), 'trace') then 0.3 else 0 end + case when contains(lower(relative_path), 'cache') then 0.3 else 0 end + case when agent_touched then 0.2 else 0 end - coalesce(cognitive_load, 0.0) * 0.3))), 6) relevance from cur),
 rel as (select id, project_id, relative_path, relevance, round(relevance * (1 - least(load, 1.0)), 6) priority, tokens from sc)"""


@core.add("context_relevance", f"with {_REL} select * from rel")
def context_relevance(spark, d):
    return M.relevance(cur(spark, d), "trace a cache")


@core.add("context_budget_greedy", f"with recursive {_REL}, rk as (select *, row_number() over (partition by project_id order by priority desc, id) n from rel), go as (select project_id, n, case when tokens <= 2000 then tokens else 0 end used, tokens <= 2000 as taken, id from rk where n = 1 union all select r.project_id, r.n, case when g.used + r.tokens <= 2000 then g.used + r.tokens else g.used end, g.used + r.tokens <= 2000, r.id from go g join rk r on r.project_id = g.project_id and r.n = g.n + 1 where r.n <= 1000) select project_id, cast(max(used) over (partition by project_id) as bigint) used, id from go qualify taken")
def context_budget_greedy(spark, d):
    return M.context_budget(M.relevance(cur(spark, d), "trace a cache"), 2000)
