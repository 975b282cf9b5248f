"""Queries of calls, flows, debt, memory, sessions and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import json_or_text, naming_convention, rolling_hash32, rolling_hash_hex
from ..operators import calls as C
from ..operators import debt as D
from ..operators import flows as L
from ..operators import upsert as U
from ..sources.tables import table
from .registry import core
from .reports import CUR, cur


def calls(spark, d):
    return table(spark, d, "calls").distinct()


_CALLS = "cl as (select distinct * from calls), fn as (select id, min(name) name from function_defs group by 1)"


@core.add("calls_normalized", f"with {_CALLS} select from_function_id, to_function_id, workload_id, cast(sum(coalesce(nullif(call_count, 0), 1)) as bigint) call_count, bool_or(coalesce(static_missed, false)) static_missed from cl group by 1, 2, 3")
def calls_normalized(spark, d):
    return C.normalize(calls(spark, d))


@core.add("calls_upsert_merge", f"with {_CALLS} select from_function_id, to_function_id, workload_id, cast(sum(coalesce(call_count, 1)) as bigint) call_count, arg_max(static_missed, struct_pack(a := detected_at, b := id)) static_missed, count(*) as \"rows\" from cl group by 1, 2, 3")
def calls_upsert_merge(spark, d):
    return C.ingest(calls(spark, d))


@core.add("calls_with_names", f"with {_CALLS} select c.id, a.name caller, b.name callee, c.call_count from cl c join fn a on a.id = c.from_function_id join fn b on b.id = c.to_function_id where c.dynamic")
def calls_with_names(spark, d):
    return C.with_names(calls(spark, d).where("dynamic"), table(spark, d, "function_defs")).select("id", "caller", "callee", "call_count")


@core.add("calls_static_missed", f"with {_CALLS} select c.id, a.name caller, b.name callee, workload_id from cl c join fn a on a.id = c.from_function_id join fn b on b.id = c.to_function_id where c.static_missed")
def calls_static_missed(spark, d):
    return C.with_names(calls(spark, d).where("static_missed"), table(spark, d, "function_defs")).select("id", "caller", "callee", "workload_id")


@core.add("calls_by_workload", f"with {_CALLS} select coalesce(workload_id, 'static') workload, count(*) calls, cast(sum(coalesce(call_count, 1)) as bigint) n, count(distinct to_function_id) callees from cl group by 1")
def calls_by_workload(spark, d):
    return calls(spark, d).groupBy(F.coalesce("workload_id", F.lit("static")).alias("workload")).agg(F.count("*").alias("calls"), F.sum(F.coalesce("call_count", F.lit(1))).cast("bigint").alias("n"), F.count_distinct("to_function_id").alias("callees"))


@core.add("calls_by_name", f"with {_CALLS} select a.name caller, b.name callee, cast(sum(coalesce(call_count, 1)) as bigint) calls from cl c join fn a on a.id = c.from_function_id join fn b on b.id = c.to_function_id group by 1, 2")
def calls_by_name(spark, d):
    return C.by_name(calls(spark, d), table(spark, d, "function_defs"))


@core.add("calls_cleared", f"with {_CALLS} select dynamic, count(*) n from cl where not coalesce(dynamic and workload_id = (select max(workload_id) from cl), false) group by 1")
def calls_cleared(spark, d):
    c = calls(spark, d)
    w = c.agg(F.max("workload_id").alias("w"))
    return U.delete(c.join(F.broadcast(w)), F.col("dynamic") & (F.col("workload_id") == F.col("w"))).groupBy("dynamic").agg(F.count("*").alias("n"))


def flow_events(spark, d):
    c = C.with_names(calls(spark, d).where("workload_id is not null"), table(spark, d, "function_defs"))
    return c.select(F.concat(F.lit("res:"), "caller").alias("source"), "callee", F.col("callee").alias("target"), "workload_id", "id")


_FLOW = f"{_CALLS}, fl as (select 'res:' || a.name source, b.name target, workload_id, c.id from cl c join fn a on a.id = c.from_function_id join fn b on b.id = c.to_function_id where workload_id is not null), fm as (select name, min(id) fid from function_defs where name is not null group by 1)"


@core.add("data_flows", f"with {_FLOW} select f.id, source, target, x.fid source_function_id, y.fid target_function_id from fl f left join fm x on x.name = source left join fm y on y.name = target")
def data_flows(spark, d):
    return L.data_flows(flow_events(spark, d), table(spark, d, "function_defs")).select("id", "source", "target", "source_function_id", "target_function_id")


@core.add("resource_flows", f"with {_FLOW} select resource, direction, other, count(*) flows from (select source resource, 'out' direction, target other from fl union all select target, 'in', source from fl) group by 1, 2, 3")
def resource_flows(spark, d):
    return L.resource_flows(flow_events(spark, d))


@core.add("resources", f"with {_FLOW} select source qualified_name from fl union select target from fl")
def resources(spark, d):
    return L.resources(flow_events(spark, d)).select("qualified_name")


_DEBT = "debt as (select o_orderkey id, o_orderpriority as type, case when o_totalprice > 300000 then 'high' when o_totalprice > 150000 then 'medium' else 'low' end severity, o_orderstatus = 'F' resolved, o_orderdate detected_at, case when o_orderstatus = 'F' then o_orderdate + interval 30 day end resolved_at, o_custkey file_id from orders)"


def debt(spark, d):
    o = table(spark, d, "orders")
    severity = F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 150000, "medium").otherwise("low")
    done = F.col("o_orderstatus") == "F"
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), severity.alias("severity"), done.alias("resolved"), F.col("o_orderdate").alias("detected_at"), F.when(done, F.col("o_orderdate") + F.expr("interval 30 days")).alias("resolved_at"), F.col("o_custkey").alias("file_id"))


TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "none-of-these"]


@core.add("debt_breakdown", f"with {_DEBT}, o as (select * from debt where not resolved), k as (select 'severity' dimension, unnest(['high', 'medium', 'low']) as value union all select 'type', unnest({TYPES})) select 'total' dimension, 'all' as value, count(*) n from o union all select dimension, value, (select count(*) from o where case when dimension = 'type' then type else severity end = k.value) from k")
def debt_breakdown(spark, d):
    return D.breakdown(debt(spark, d), TYPES)


@core.add("debt_page", f"with {_DEBT} select id, type, severity, detected_at from debt where not resolved and severity = 'high' order by detected_at desc, id limit 20 offset 20")
def debt_page(spark, d):
    return D.page(debt(spark, d), 20, 20, severity="high").select("id", "type", "severity", "detected_at")


@core.add("debt_prioritized", f"with {_DEBT} select id, severity, case severity when 'high' then 3 when 'medium' then 2 else 1 end weight, detected_at from debt where not resolved order by 3 desc, detected_at desc, id limit 50")
def debt_prioritized(spark, d):
    return D.prioritized(debt(spark, d)).select("id", "severity", "weight", "detected_at")


@core.add("debt_cleanup", f"with {_DEBT}, m as (select max(detected_at) m from debt) select severity, resolved, count(*) n from debt, m where not coalesce((resolved and resolved_at < m - interval 90 day) or (not resolved and severity = 'low' and detected_at < m - interval 90 day), false) group by 1, 2")
def debt_cleanup(spark, d):
    x = debt(spark, d)
    m = x.agg(F.max("detected_at").alias("m"))
    return D.cleanup(x.join(F.broadcast(m)), F.col("m"), 90).groupBy("severity", "resolved").agg(F.count("*").alias("n"))


@core.add("debt_resolved", f"with {_DEBT}, m as (select max(detected_at) m from debt) select resolved or id % 100 = 0 resolved, count(*) n, cast(max(case when id % 100 = 0 then m else resolved_at end) as timestamp) last_end from debt, m group by 1")
def debt_resolved(spark, d):
    x = debt(spark, d)
    m = x.agg(F.max("detected_at").alias("m"))
    return D.resolve(x.join(F.broadcast(m)), x.where("id % 100 = 0").select("id"), F.col("m")).groupBy("resolved").agg(F.count("*").alias("n"), F.max("resolved_at").alias("last_end"))


@core.add("debt_with_files", f"with {_DEBT}, {CUR} select coalesce(c.relative_path, 'unknown') path, count(*) n from debt left join cur c on c.id = file_id where not resolved group by 1")
def debt_with_files(spark, d):
    f = cur(spark, d, "relative_path").withColumnRenamed("id", "file_id")
    return debt(spark, d).where("not resolved").join(f, "file_id", "left").groupBy(F.coalesce("relative_path", F.lit("unknown")).alias("path")).agg(F.count("*").alias("n"))


@core.add("refactor_roi", f"""with {CUR}, w as (select file_id, max(complexity) worst from function_defs group by 1), t as (select user_id file_id, count(*) churn from events group by 1),
f as (select c.id, size_bytes, cognitive_load, coalesce(churn, 0) churn, worst, greatest(cast(ceil(coalesce(size_bytes, 0) / 50 / 100) as bigint), 1) effort from cur c left join w on w.file_id = c.id left join t on t.file_id = c.id),
u as (select id, 'load' reason, cognitive_load reduction, churn, effort from f where cognitive_load > 0.2 union all select id, 'complexity', least(worst / 20.0, 1.0), churn, effort from f where worst > 10 union all select id, 'size', 0.5, churn, effort from f where size_bytes > 5000), r as (select id, reason, effort, round(cast(reduction as double) * (churn + 1) / effort, 2) roi from u)
select *, case when roi > 3 then 'critical' when roi > 1.5 then 'high' when roi > 0.8 then 'medium' else 'low' end priority from r""")
def refactor_roi(spark, d):
    worst = table(spark, d, "function_defs").groupBy("file_id").agg(F.max("complexity").alias("worst"))
    churn = table(spark, d, "events").groupBy(F.col("user_id").alias("file_id")).agg(F.count("*").alias("churn"))
    return D.refactor_roi(cur(spark, d), worst, churn)


@core.add("sessions_latest", "select user_id agent, arg_max(event_type, struct_pack(a := ts, b := event_id)) last_kind, max(ts) last_seen, count(*) n from events group by 1")
def sessions_latest(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("agent")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


@core.add("sessions_recent50", "select event_id id, user_id agent, ts from events order by ts desc, event_id limit 50")
def sessions_recent50(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("agent"), "ts").orderBy(F.desc("ts"), "id").limit(50)


_MEM = "mem as (select event_id id, user_id session_id, event_type scope, json_extract_string(props, '$.k') as key, value, ts created_at, case when event_id % 3 = 0 then ts + interval 5 day end expires_at from events)"


def memory(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("scope"), F.get_json_object("props", "$.k").alias("key"), "value", F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("interval 5 days")).alias("expires_at"))


@core.add("memory_scope", f"with {_MEM}, m as (select max(created_at) m from mem) select id, key, value from mem, m where scope = 'click' and key = '7' and (expires_at is null or expires_at > m)")
def memory_scope(spark, d):
    x = memory(spark, d)
    now = x.agg(F.max("created_at").alias("now"))
    return U.expire(x.where("scope = 'click' and key = '7'").join(F.broadcast(now)), "expires_at", F.col("now")).select("id", "key", "value")


@core.add("memory_ttl", f"with {_MEM}, m as (select max(created_at) m from mem) select scope, count(*) n from mem, m where expires_at is null or expires_at > m group by 1")
def memory_ttl(spark, d):
    x = memory(spark, d)
    now = x.agg(F.max("created_at").alias("now"))
    return U.expire(x.join(F.broadcast(now)), "expires_at", F.col("now")).groupBy("scope").agg(F.count("*").alias("n"))


@core.add("team_memory_upsert", f"with {_MEM} select scope, key, arg_max(value, struct_pack(a := created_at, b := id)) as value, arg_max(session_id, struct_pack(a := created_at, b := id)) agent from mem group by 1, 2")
def team_memory_upsert(spark, d):
    x = memory(spark, d).select("scope", "key", "value", F.col("session_id").alias("agent"), "created_at", "id")
    return U.last_write_wins(x, ["scope", "key"], ["created_at", "id"]).select("scope", "key", "value", "agent")


@core.add("team_memory_visible", f"with {_MEM}, t as (select scope, key, arg_max(struct_pack(v := value, a := session_id, p := id % 2 = 0), struct_pack(a := created_at, b := id)) r from mem group by 1, 2) select scope, key, r.v as value from t where scope = 'view' and (r.p or r.a = 7)")
def team_memory_visible(spark, d):
    x = memory(spark, d).select("scope", "key", "value", F.col("session_id").alias("agent"), (F.col("id") % 2 == 0).alias("is_public"), "created_at", "id")
    return U.last_write_wins(x, ["scope", "key"], ["created_at", "id"]).where((F.col("scope") == "view") & (F.col("is_public") | (F.col("agent") == 7))).select("scope", "key", "value")


@core.add("files_upsert", "with x as (select *, row_number() over (partition by project_id, path order by last_scanned desc nulls last, id desc, hash desc nulls last) rn from files) select project_id, count(*) files, cast(sum(coalesce(size_bytes, 0)) as bigint) bytes from x where rn = 1 group by 1")
def files_upsert(spark, d):
    f = table(spark, d, "files").select("project_id", "path", "size_bytes", "hash", "last_scanned", "id")
    old, new = f.where("last_scanned < timestamp_ntz'2025-01-01'"), f.where("not coalesce(last_scanned < timestamp_ntz'2025-01-01', false)")
    return U.upsert(old, new, ["project_id", "path"], ["last_scanned", "id", "hash"]).groupBy("project_id").agg(F.count("*").alias("files"), F.sum(F.coalesce("size_bytes", F.lit(0))).cast("bigint").alias("bytes"))


@core.add("json_props", "select event_type, count(*) n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) k from events group by 1")
def json_props(spark, d):
    e = table(spark, d, "events").withColumn("v", json_or_text(F.col("props")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.try_variant_get("v", "$.k", "bigint")).cast("bigint").alias("k"))


_NAMES = "case when regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') then 'camelCase' when regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') then 'PascalCase' when regexp_matches(name, '^[a-z][a-z0-9_]*$') then 'snake_case' when regexp_matches(name, '^[A-Z][A-Z0-9_]*$') then 'SCREAMING_SNAKE' else 'unknown' end"


@core.add("naming_conventions", f"select {_NAMES} convention, count(distinct name) names, count(*) n from (select distinct * exclude (embedding) from function_defs) group by 1")
def naming_conventions(spark, d):
    f = table(spark, d, "function_defs").drop("embedding").distinct()
    return f.groupBy(naming_convention(F.col("name")).alias("convention")).agg(F.count_distinct("name").alias("names"), F.count("*").alias("n"))


@core.add("pattern_upsert", f"with f as (select distinct * exclude (embedding) from function_defs), p as (select f.id, md5(f.name) code_hash, {_NAMES} pattern, case {_NAMES} when 'unknown' then 0.5 when 'camelCase' then 0.9 when 'PascalCase' then 0.9 else 0.85 end confidence from f) select code_hash, pattern, count(*) usage_count, cast(arg_max(confidence, id) as double) confidence, min(id) first_id, max(id) last_id from p group by 1, 2")
def pattern_upsert(spark, d):
    return patterns(spark, d)


def patterns(spark, d):
    f = table(spark, d, "function_defs").select("id", "name").distinct()
    kind = naming_convention(F.col("name"))
    conf = F.when(kind == "unknown", 0.5).when(kind.isin("camelCase", "PascalCase"), 0.9).otherwise(0.85)
    p = f.select("id", F.md5("name").alias("code_hash"), kind.alias("pattern"), conf.alias("confidence"))
    return p.groupBy("code_hash", "pattern").agg(F.count("*").alias("usage_count"), F.max_by("confidence", "id").alias("confidence"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@core.add("pattern_confidence", f"with f as (select distinct id, name from function_defs), p as (select md5(name) h, {_NAMES} pattern, count(*) u, cast(max(case {_NAMES} when 'unknown' then 0.5 when 'camelCase' then 0.9 when 'PascalCase' then 0.9 else 0.85 end) as double) c from f group by 1, 2) select round(coalesce(avg(c), 1.0), 6) average, round(coalesce(sum(c * greatest(u, 1)) / sum(greatest(u, 1)), 1.0), 6) weighted, count_if(c >= 0.8) strong, count(*) patterns from p")
def pattern_confidence(spark, d):
    u = F.greatest("usage_count", F.lit(1))
    return patterns(spark, d).agg(F.round(F.coalesce(F.avg("confidence"), F.lit(1.0)), 6).alias("average"), F.round(F.coalesce(F.try_divide(F.sum(F.col("confidence") * u), F.sum(u)), F.lit(1.0)), 6).alias("weighted"), F.count_if(F.col("confidence") >= 0.8).alias("strong"), F.count("*").alias("patterns"))


@core.add("name_diff_duplicates", "with f as (select distinct file_id, name, regexp_replace(coalesce(signature, ''), '[ \\t\\n]+', ' ', 'g') s from function_defs) select name, count(distinct s) signatures, count(distinct file_id) files from f group by 1 having count(distinct s) > 1 and count(distinct file_id) > 1")
def name_diff_duplicates(spark, d):
    f = table(spark, d, "function_defs").select("file_id", "name", F.regexp_replace(F.coalesce("signature", F.lit("")), "[ \\t\\n]+", " ").alias("s")).distinct()
    return f.groupBy("name").agg(F.count_distinct("s").alias("signatures"), F.count_distinct("file_id").alias("files")).where("signatures > 1 and files > 1")


@core.add("in_file_duplicates", "with f as (select distinct id, file_id, name, start_line from function_defs) select id, file_id, name from (select *, row_number() over (partition by file_id, name order by start_line, id) rn from f) where rn > 1")
def in_file_duplicates(spark, d):
    from pyspark.sql import Window

    f = table(spark, d, "function_defs").select("id", "file_id", "name", "start_line").distinct()
    return f.withColumn("rn", F.row_number().over(Window.partitionBy("file_id", "name").orderBy("start_line", "id"))).where("rn > 1").select("id", "file_id", "name")


@core.add("exact_duplicates", "select md5(text) hash, count(*) copies, min(doc_id) first_id from documents group by 1 having count(*) > 1")
def exact_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@core.add("rolling_hash", """with x as (select distinct name from function_defs), h as (select name, list_reduce(list_prepend(cast(0 as hugeint), list_transform(string_split(name, ''), lambda c: cast(ord(c) as hugeint))), lambda a, u: (a * 31 + u) % 4294967296) h from x) select name, cast(case when h >= 2147483648 then 4294967296 - h else h end as bigint) hash, lower(to_hex(cast(case when h >= 2147483648 then 4294967296 - h else h end as bigint))) hash_hex from h""")
def rolling_hash(spark, d):
    n = table(spark, d, "function_defs").select("name").distinct()
    return n.select("name", rolling_hash32(F.col("name")).cast("bigint").alias("hash"), rolling_hash_hex(F.col("name")).alias("hash_hex"))
