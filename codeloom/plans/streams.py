"""Queries of windows (as batches, comparable with SQL) and of streams that run over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import checkpoint_dir
from ..sources import code_tree as T
from ..sources import sinks as K
from ..sources.tables import table
from ..streaming import counters as C
from .graphs import _MODS, _RES, edges, modules
from .registry import core


@core.add("tumbling_counts", "select cast(date_trunc('day', ts) as timestamp) as start, event_type, count(*) n, round(sum(value), 4) as value from events group by 1, 2")
def tumbling_counts(spark, d):
    return C.tumbling(table(spark, d, "events")).withColumn("value", F.round("value", 4))


@core.add("sliding_counts", "select cast(day - k * interval 1 day as timestamp) as start, event_type, count(*) n from (select date_trunc('day', ts) as day, event_type, unnest([0, 1]) k from events) group by 1, 2")
def sliding_counts(spark, d):
    return C.sliding(table(spark, d, "events"))


@core.add("session_windows", "with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 24 hour then 0 else 1 end fresh from events), y as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) s from x) select cast(min(ts) as timestamp) as start, user_id, count(*) n from y group by user_id, s")
def session_windows(spark, d):
    return C.sessions(table(spark, d, "events"))


@core.add("stream_counter", "select event_type, user_id, count(*) as total from events group by 1, 2")
def stream_counter(spark, d):
    """The counters of a stream over the events after all of it has come."""
    events = table(spark, d, "events")
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events.repartition(4).write.parquet(f"{base}/in")
    s = C.call_counter(C.events_stream(spark, f"{base}/in").withColumn("one", F.lit(1)), ["event_type", "user_id"], "one")
    C.run_once(s, "update", f"{base}/out", f"{base}/checkpoint")
    return C.latest_of(spark, f"{base}/out", ["event_type", "user_id"]).select("event_type", "user_id", "total")


@core.add("catalog", "select 'files' as name, count(*) row_count from files union all select 'imports', count(*) from imports union all select 'calls', count(*) from calls union all select 'function_defs', count(*) from function_defs union all select 'deletions', count(*) from deletions")
def catalog(spark, d):
    return T.catalog(spark, d, ["files", "imports", "calls", "function_defs", "deletions"])


_ALL = ("calls", "code_inputs", "customer", "deletions", "documents", "embeddings", "eval_items", "events", "files", "function_defs", "imports", "lineitem", "nation", "orders", "part", "projects", "region", "supplier")


@core.add("catalog_all", " union all ".join(f"select '{n}' as name, count(*) row_count from {n}" for n in _ALL))
def catalog_all(spark, d):
    """All tables that the folder holds."""
    return T.catalog(spark, d, T.tables_in(spark, d))


@core.add("module_mermaid", f"with {_RES}, {_MODS}, g as (select x.module a, y.module b, count(*) links from ed join md x on x.node = ed.src join md y on y.node = ed.dst where starts_with(x.module, '3:') group by 1, 2), l as (select '  ' || regexp_replace(a, '[^A-Za-z0-9]', '_', 'g') || ' -->|' || links || '| ' || regexp_replace(b, '[^A-Za-z0-9]', '_', 'g') line from g) select concat_ws(chr(10), 'graph TD', (select string_agg(line, chr(10) order by line) from l)) as text")
def module_mermaid(spark, d):
    return G.mermaid(G.module_edges(edges(spark, d), modules(spark, d)))


@core.add("project_report_markdown", "with p as (select p.id, p.name, count(distinct f.id) files from projects p left join files f on f.project_id = p.id group by 1, 2) select '| id | name | files |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || id || ' | ' || name || ' | ' || files || ' |', chr(10) order by id) as text from p")
def project_report_markdown(spark, d):
    f = table(spark, d, "files").groupBy("project_id").agg(F.count_distinct("id").alias("n"))
    p = table(spark, d, "projects").select("id", "name").join(f, F.col("id") == F.col("project_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("files"))
    return K.markdown_table(p, ["id"])
