"""Queries of writes, lookups and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import debt as D
from ..operators import graph as G
from ..operators import store as S
from ..operators import upsert as U
from ..sources.tables import table
from ..streaming import counters as C
from .graphs import _RES, edges, states
from .records import _DEBT, debt
from .registry import core
from .reports import CUR, cur

#: Project that the queries below delete or look up.
PROJECT, NAME = 3, "default"


@core.add("project_deleted", f"select project_id, count(distinct id) files from files where project_id is null or project_id <> {PROJECT} group by 1")
def project_deleted(spark, d):
    _, files = S.delete_project(table(spark, d, "projects"), table(spark, d, "files"), PROJECT)
    return files.groupBy("project_id").agg(F.count_distinct("id").alias("files"))


_TOUCH = "tc as (select e.event_id seq, c.project_id, case when e.value > 10 then c.path else c.relative_path end p, 'agent-' || event_type agent, e.ts moment from events e join cur c on c.id = e.user_id)"


def touches(spark, d):
    f = cur(spark, d, "project_id", "path", "relative_path").withColumnRenamed("id", "user_id")
    e = table(spark, d, "events").join(f, "user_id")
    return e.select("project_id", F.when(F.col("value") > 10, F.col("path")).otherwise(F.col("relative_path")).alias("path"), F.concat(F.lit("agent-"), "event_type").alias("agent"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@core.add("marked_touched", f"with {CUR}, {_TOUCH}, m as (select c.id, arg_max(agent, struct_pack(a := moment, b := seq)) agent, max(moment) moment from cur c join tc on tc.project_id = c.project_id and (tc.p = c.path or tc.p = c.relative_path) group by 1) select c.id, coalesce(m.id is not null or agent_touched, agent_touched) touched, coalesce(m.agent, agent_touched_by) agent, coalesce(m.moment, agent_touched_at) moment from cur c left join m on m.id = c.id")
def marked_touched(spark, d):
    return S.mark_touched(cur(spark, d), touches(spark, d)).select("id", F.col("agent_touched").alias("touched"), F.col("agent_touched_by").alias("agent"), F.col("agent_touched_at").alias("moment"))


@core.add("index_rebuilt", "select unnest(['files', 'imports', 'function_defs', 'calls']) as name, cast(0 as bigint) row_count")
def index_rebuilt(spark, d):
    out = None
    for n in ("files", "imports", "function_defs", "calls"):
        c = S.truncate(table(spark, d, n)).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("name"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out


@core.add("cycles_stored", f"with {_RES} select x.src a, x.dst b, 2 as length from ed x join ed y on x.src = y.dst and x.dst = y.src where x.src < x.dst")
def cycles_stored(spark, d):
    """Cycles found twice are stored once."""
    found = G.mutual(edges(spark, d)).withColumn("length", F.lit(2))
    return S.insert_new(S.insert_new(S.truncate(found), found, ["a", "b"]), found, ["a", "b"])


_OLD = "timestamp '0001-01-01'"


@core.add("decisions_upsert", f"select md5(text) code_hash, arg_max(doc_id, struct_pack(a := coalesce(created_at, {_OLD}), b := doc_id)) doc_id, arg_max(source, struct_pack(a := coalesce(created_at, {_OLD}), b := doc_id)) source from documents where doc_kind = 'adr' group by 1")
def decisions_upsert(spark, d):
    x = table(spark, d, "documents").where("doc_kind = 'adr'").select(F.md5("text").alias("code_hash"), "doc_id", "source", F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"))
    return U.last_write_wins(x, ["code_hash"], ["at", "doc_id"]).select("code_hash", "doc_id", "source")


@core.add("genome_snapshots", "with m as (select project_id, date_trunc('month', last_scanned) taken_at, count(distinct id) files, cast(sum(coalesce(size_bytes, 0)) as bigint) bytes from (select distinct id, project_id, last_scanned, size_bytes from files where last_scanned is not null) group by 1, 2) select project_id, md5(files || ':' || bytes) checksum, cast(max(taken_at) as timestamp) taken_at, max(files) files from m group by 1, 2")
def genome_snapshots(spark, d):
    f = table(spark, d, "files").where("last_scanned is not null").select("id", "project_id", "last_scanned", "size_bytes").distinct()
    m = f.groupBy("project_id", F.date_trunc("month", "last_scanned").cast("timestamp_ntz").alias("taken_at")).agg(F.count_distinct("id").alias("files"), F.sum(F.coalesce("size_bytes", F.lit(0))).cast("bigint").alias("bytes"))
    return S.snapshots(m, F.md5(F.concat_ws(":", "files", "bytes")), ["project_id"], "taken_at").select("project_id", "checksum", "taken_at", "files")


@core.add("settings_upsert", "select event_type as key, arg_max(user_id, struct_pack(a := ts, b := event_id)) as value from events group by 1")
def settings_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("value"), "ts", "event_id")
    return U.upsert(S.truncate(e), e, ["key"], ["ts", "event_id"]).select("key", "value")


_BY_NAME = "cl as (select distinct * from calls), fn as (select id, min(name) name from function_defs group by 1), nm as (select distinct name from function_defs where name is not null), tr as (select coalesce(a.name, 'fn-' || from_function_id) from_name, coalesce(b.name, 'fn-' || to_function_id) to_name, workload_id, call_count, static_missed, detected_at, cl.id seq from cl left join fn a on a.id = from_function_id left join fn b on b.id = to_function_id), ig as (select from_name, to_name, workload_id, cast(sum(coalesce(call_count, 1)) as bigint) call_count, from_name not in (select name from nm) from_stub, to_name not in (select name from nm) to_stub from tr where from_name is not null and to_name is not null group by 1, 2, 3)"


def traces_by_name(spark, d):
    c = table(spark, d, "calls").distinct()
    f = table(spark, d, "function_defs").where("id is not null").groupBy("id").agg(F.min("name").alias("name"))
    for end in ("from", "to"):
        c = c.join(f.select(F.col("id").alias(f"{end}_function_id"), F.col("name").alias(f"_{end}")), f"{end}_function_id", "left").withColumn(f"{end}_name", F.coalesce(f"_{end}", F.concat(F.lit("fn-"), F.col(f"{end}_function_id").cast("string"))))
    return c.where("from_name is not null and to_name is not null").select("from_name", "to_name", "workload_id", "call_count", "static_missed", F.struct("detected_at", "id").alias("seq"))


@core.add("calls_ingested_by_name", f"with {_BY_NAME} select * from ig")
def calls_ingested_by_name(spark, d):
    e, _ = S.ingest_by_name(traces_by_name(spark, d), table(spark, d, "function_defs"))
    return e.select("from_name", "to_name", "workload_id", "call_count", "from_stub", "to_stub")


@core.add("function_stubs", f"with {_BY_NAME} select from_name as name from ig where from_stub union select to_name from ig where to_stub")
def function_stubs(spark, d):
    _, stubs = S.ingest_by_name(traces_by_name(spark, d), table(spark, d, "function_defs"))
    return stubs.select("name")


@core.add("debt_paths", f"with {_DEBT}, {CUR}, x as (select d.id, case when severity = 'high' then c.path when severity = 'low' then c.relative_path else 'no/such/file' end p from debt d join cur c on c.id = d.file_id), a as (select path p, min(id) fid from cur group by 1), b as (select relative_path p, min(id) fid from cur group by 1) select x.id, coalesce(a.fid, b.fid) file_id from x left join a on a.p = x.p left join b on b.p = x.p")
def debt_paths(spark, d):
    f = cur(spark, d, "path", "relative_path")
    x = debt(spark, d).select(F.col("id").alias("item"), "severity", F.col("file_id").alias("id")).join(f, "id")
    p = F.when(F.col("severity") == "high", F.col("path")).when(F.col("severity") == "low", F.col("relative_path")).otherwise("no/such/file")
    return S.lookup_paths(x.select(F.col("item"), p.alias("path")), f).select(F.col("item").alias("id"), "file_id")


@core.add("file_by_path", f"with {CUR}, x as (select distinct c.project_id, i.resolved_path p from imports i join cur c on c.id = i.file_id where i.resolved_path is not null), a as (select project_id, path p, min(id) fid from cur group by 1, 2), b as (select project_id, relative_path p, min(id) fid from cur group by 1, 2) select x.project_id, x.p as path, coalesce(a.fid, b.fid) file_id from x left join a on a.p = x.p and a.project_id = x.project_id left join b on b.p = x.p and b.project_id = x.project_id")
def file_by_path(spark, d):
    f = cur(spark, d, "project_id", "path", "relative_path")
    i = table(spark, d, "imports").where("resolved_path is not null").select(F.col("file_id").alias("id"), "resolved_path")
    return S.lookup_paths(i.join(f.select("id", "project_id"), "id").select("project_id", F.col("resolved_path").alias("path")).distinct(), f)


_GONE = f"{_RES}, gn as (select id from st where deleted_from is not null)"


@core.add("details_deleted", f"with {_GONE} select 'functions' kind, count(distinct id) n from function_defs where file_id is null or file_id not in (select id from gn) union all select 'imports', count(distinct id) from imports where file_id is null or file_id not in (select id from gn)")
def details_deleted(spark, d):
    """Functions and imports left once those of deleted files are gone."""
    gone = states(spark, d).where("deleted_from is not null").select(F.col("id").alias("file_id"))
    left = lambda name, kind: U.delete_keys(table(spark, d, name), gone, ["file_id"]).agg(F.count_distinct("id").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return left("function_defs", "functions").unionByName(left("imports", "imports"))


@core.add("scan_profiles", f"with {CUR} select id project_id, last_scanned scanned_at, cast(null as bigint) files from projects where last_scanned is not null union all select project_id, max(last_scanned), count(*) from cur where project_id is not null group by 1")
def scan_profiles(spark, d):
    old = table(spark, d, "projects").where("last_scanned is not null").select(F.col("id").alias("project_id"), F.col("last_scanned").alias("scanned_at"))
    new = cur(spark, d, "project_id", "last_scanned").where("project_id is not null").groupBy("project_id").agg(F.max("last_scanned").alias("scanned_at"), F.count("*").alias("files"))
    return S.append(old, new)


@core.add("session_intervals", "with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 24 hour then 0 else 1 end fresh from events), y as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) s from x) select user_id, cast(min(ts) as timestamp) started_at, cast(max(ts) as timestamp) ended_at, count(*) n from y group by user_id, s")
def session_intervals(spark, d):
    return C.session_intervals(table(spark, d, "events"))


_ACTIVE = "x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 24 hour then 0 else 1 end fresh from events), y as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) s from x), si as (select user_id, min(ts) started_at, max(ts) ended_at from y group by user_id, s), ac as (select user_id, started_at from si, (select max(ts) m from events) where ended_at >= m - interval 24 hour)"


def active(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return C.session_intervals(e).join(F.broadcast(now)).where(F.col("ended_at") >= F.col("now") - F.expr("interval 24 hours")).select("user_id", "started_at")


@core.add("active_sessions10", f"with {_ACTIVE} select user_id, cast(started_at as timestamp) started_at from ac order by ac.started_at desc, user_id limit 10")
def active_sessions10(spark, d):
    return active(spark, d).orderBy(F.desc("started_at"), "user_id").limit(10)


@core.add("agent_status", f"with {_ACTIVE}, {CUR} select (select count(*) from ac) active_sessions, count_if(agent_touched) touched, count(*) files, round(count_if(agent_touched) / greatest(count(*), 1), 6) coverage from cur")
def agent_status(spark, d):
    f = cur(spark, d, "agent_touched").agg(F.count_if("agent_touched").alias("touched"), F.count("*").alias("files"))
    one = active(spark, d).agg(F.count("*").alias("active_sessions")).crossJoin(f)
    return one.withColumn("coverage", F.round(F.col("touched") / F.greatest("files", F.lit(1)), 6))


@core.add("recent_touches20", f"with {CUR} select id, agent_touched_by agent, agent_touched_at moment from cur where agent_touched order by agent_touched_at desc nulls last, id limit 20")
def recent_touches20(spark, d):
    f = cur(spark, d, "agent_touched", "agent_touched_by", "agent_touched_at").where("agent_touched")
    return f.orderBy(F.desc_nulls_last("agent_touched_at"), "id").limit(20).select("id", F.col("agent_touched_by").alias("agent"), F.col("agent_touched_at").alias("moment"))


@core.add("sessions_of_agents", "select user_id agent, event_id id, ts, cast(row_number() over (partition by user_id order by ts desc, event_id) as int) place from events qualify place <= 50")
def sessions_of_agents(spark, d):
    """The latest 50 of each agent."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, d, "events").withColumn("place", F.row_number().over(w)).where("place <= 50").select(F.col("user_id").alias("agent"), F.col("event_id").alias("id"), "ts", "place")


@core.add("sessions_by_agent_latest50", "select user_id agent, count(*) sessions, max(ts) last_seen from (select * from events order by ts desc, event_id limit 50) group by 1")
def sessions_by_agent_latest50(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(50).groupBy(F.col("user_id").alias("agent")).agg(F.count("*").alias("sessions"), F.max("ts").alias("last_seen"))


@core.add("file_children", "select file_id, 'function' kind, id, name from function_defs union select file_id, 'import', id, source from imports")
def file_children(spark, d):
    f = table(spark, d, "function_defs").select("file_id", F.lit("function").alias("kind"), "id", "name")
    i = table(spark, d, "imports").select("file_id", F.lit("import").alias("kind"), "id", F.col("source").alias("name"))
    return f.unionByName(i).distinct()


@core.add("file_embeddings", "select id, len(embedding) dims, round(list_sum(embedding), 4) total from (select id, arg_max(coalesce(embedding, []), struct_pack(a := last_scanned, b := coalesce(hash, ''), c := coalesce(size_bytes, -1))) embedding from files where id is not null and last_scanned is not null group by 1) where len(embedding) > 0")
def file_embeddings(spark, d):
    f = cur(spark, d, "embedding").where("embedding is not null and size(embedding) > 0")
    return f.select("id", F.size("embedding").cast("bigint").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@core.add("file_decisions", f"with {_DEBT} select file_id, id, cast(row_number() over (partition by file_id order by detected_at desc, id) as int) place from debt")
def file_decisions(spark, d):
    """What is recorded for a file, newest first."""
    return debt(spark, d).select("file_id", "id", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("detected_at"), "id")).alias("place"))


@core.add("files_by_import_pattern", f"with {CUR} select id, relative_path from cur where contains(lower(relative_path), lower('Trace'))")
def files_by_import_pattern(spark, d):
    return cur(spark, d, "relative_path").where(F.contains(F.lower("relative_path"), F.lower(F.lit("Trace")))).select("id", "relative_path")


@core.add("project_lookup", f"select id, name, root_path from projects where name = '{NAME}'")
def project_lookup(spark, d):
    return table(spark, d, "projects").where(F.col("name") == NAME).select("id", "name", "root_path")


@core.add("schema_version", "select max(id) as version from projects")
def schema_version(spark, d):
    """The greatest of the numbered rows of a table, as for applied migrations."""
    return table(spark, d, "projects").agg(F.max("id").alias("version"))


@core.add("debt_page_more", f"with {_DEBT}, o as (select * from debt where not resolved and severity = 'medium') select id, (select count(*) from o) > 60 has_more from o order by detected_at desc, id limit 20 offset 40")
def debt_page_more(spark, d):
    return D.page_with_more(debt(spark, d), 20, 40, severity="medium").select("id", "has_more")


@core.add("watched_changes", f"with {CUR}, w as (select id, agent_touched_by agent from cur where agent_touched and agent_touched_by is not null), c as (select distinct id, last_scanned, hash from files where last_scanned >= timestamp '2025-03-01') select agent, c.id, last_scanned, hash from c join w on w.id = c.id")
def watched_changes(spark, d):
    """Changes of the files that somebody watches."""
    watch = cur(spark, d, "agent_touched", "agent_touched_by").where("agent_touched and agent_touched_by is not null").select("id", F.col("agent_touched_by").alias("agent"))
    changes = table(spark, d, "files").where("last_scanned >= timestamp_ntz'2025-03-01'").select("id", "last_scanned", "hash").distinct()
    return C.enrich(changes, watch, "id").where("agent is not null").select("agent", "id", "last_scanned", "hash")


@core.add("context_sync", "with m as (select event_type scope, json_extract_string(props, '$.k') as key, arg_max(value, struct_pack(a := ts, b := event_id)) as value, max(ts) moment from events group by 1, 2) select key, value from m where scope = 'view' and moment >= timestamp '2024-01-15'")
def context_sync(spark, d):
    """What is pulled of a scope after all has been pushed to it: the last value of each key that changed since a time."""
    e = table(spark, d, "events").select(F.col("event_type").alias("scope"), F.get_json_object("props", "$.k").alias("key"), "value", "ts", "event_id")
    return U.last_write_wins(e, ["scope", "key"], ["ts", "event_id"]).where("scope = 'view' and ts >= timestamp_ntz'2024-01-15'").select("key", "value")


@core.add("file_details", f"with {_RES}, f as (select file_id, count(distinct id) functions from function_defs group by 1), i as (select i.file_id, count(distinct i.id) imports, count(distinct case when rs.resolved_id is not null then i.id end) resolved from imports i left join rs on rs.ref_id = i.id group by 1) select coalesce(f.file_id, i.file_id) file_id, coalesce(functions, 0) functions, coalesce(imports, 0) imports, coalesce(resolved, 0) resolved from f full join i on i.file_id = f.file_id")
def file_details(spark, d):
    """What is stored of nested structures of files."""
    fn = table(spark, d, "function_defs").where("file_id is not null").groupBy("file_id").agg(F.collect_set(F.struct("id", "name", "start_line")).alias("functions"))
    im = table(spark, d, "imports").where("file_id is not null").groupBy("file_id").agg(F.collect_set(F.struct("id", "source", "resolved_path")).alias("imports"))
    functions, imports = S.file_details(fn.join(im, "file_id", "full_outer"), states(spark, d))
    f = functions.groupBy("file_id").agg(F.count_distinct("id").alias("functions"))
    i = imports.groupBy("file_id").agg(F.count_distinct("id").alias("imports"), F.count("resolved_id").alias("resolved"))
    return f.join(i, "file_id", "full_outer").na.fill(0, ["functions", "imports", "resolved"])


@core.add("cognitive_loads", f"with {CUR}, f as (select file_id, sum(coalesce(complexity, 1)) cc, count(*) n from (select distinct id, file_id, complexity from function_defs) group by 1), i as (select file_id, count(distinct id) n from imports group by 1) select c.id, round((coalesce(cc, 0) * 0.5 + coalesce(i.n, 0) * 0.3 + coalesce(f.n, 0) * 0.2) / 100, 6) load from cur c left join f on f.file_id = c.id left join i on i.file_id = c.id")
def cognitive_loads(spark, d):
    """The load of each file as an upsert works it out anew."""
    from ..functions.scalars import cognitive_load

    f = table(spark, d, "function_defs").select("id", "file_id", "complexity").distinct().groupBy(F.col("file_id").alias("id")).agg(F.sum(F.coalesce("complexity", F.lit(1))).alias("cc"), F.count("*").alias("f"))
    i = table(spark, d, "imports").groupBy(F.col("file_id").alias("id")).agg(F.count_distinct("id").alias("i"))
    j = cur(spark, d, "hash").join(f, "id", "left").join(i, "id", "left").na.fill(0, ["cc", "f", "i"])
    return j.select("id", F.round(cognitive_load(F.col("cc"), F.col("i"), F.col("f")), 6).cast("double").alias("load"))
