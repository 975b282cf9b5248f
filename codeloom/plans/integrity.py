"""Queries of the hierarchy and reference operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import references as R
from ..sources.tables import table
from .registry import core


def _edges(spark, d):
    ids = table(spark, d, "function_defs").select("id").where("id is not null").distinct()
    e = table(spark, d, "calls").select("from_function_id", "to_function_id").distinct()
    e = e.join(ids.withColumnRenamed("id", "from_function_id"), "from_function_id", "left_semi")
    return e.join(ids.withColumnRenamed("id", "to_function_id"), "to_function_id", "left_semi")


_EDGES = """e as (select distinct from_function_id p, to_function_id c from calls
  where from_function_id in (select id from function_defs) and to_function_id in (select id from function_defs)),
up as (select c n, p a from e union select up.n, e.p from up join e on e.c = up.a),
ring as (select n, least(n, min(a)) root from up where n in (select x.n from up x where x.n = x.a) and a in (select x.n from up x where x.n = x.a) group by n having bool_or(n = a)),
top as (select n, root, 0 depth, 1 on_cycle from ring
  union all select distinct p, p, 0, 0 from e where p not in (select c from e)),
tree as (select n, root, depth, on_cycle, cast([n] as bigint[]) path from top
  union all select e.c, t.root, t.depth + 1, 0, list_append(t.path, e.c) from tree t join e on e.p = t.n where e.c not in (select n from ring))"""

P3_SQL = f"with recursive {_EDGES} select n function_id, root root_id, cast(depth as int) depth, cast(on_cycle as int) on_cycle from tree"


@core.add("p3_found", P3_SQL)
def p3_found(spark, d):
    h = H.link_hierarchies(_edges(spark, d), "from_function_id", "to_function_id", with_path=False)
    return h.select(F.col("node").alias("function_id"), F.col("root").alias("root_id"), "depth", "on_cycle")


@core.add("p3_paths", f"with recursive {_EDGES} select n function_id, root root_id, cast(depth as int) depth, array_to_string(path, '/') path from tree")
def p3_paths(spark, d):
    h = H.link_hierarchies(_edges(spark, d), "from_function_id", "to_function_id")
    return h.select(F.col("node").alias("function_id"), F.col("root").alias("root_id"), "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@core.add("p3_descendants", f"with recursive {_EDGES} select path[i] function_id, n descendant_id, cast(depth - i + 1 as int) distance from (select *, unnest(range(1, len(path))) i from tree)")
def p3_descendants(spark, d):
    h = H.link_hierarchies(_edges(spark, d), "from_function_id", "to_function_id")
    return H.descendants(h).select(F.col("node").alias("function_id"), F.col("descendant").alias("descendant_id"), "distance")


@core.add("p3_subtree_sizes", f"with recursive {_EDGES} select function_id, count(*) - 1 descendants, cast(max(dist) as int) height from (select path[i] function_id, depth - i + 1 dist from (select *, unnest(range(1, len(path) + 1)) i from tree)) group by 1")
def p3_subtree_sizes(spark, d):
    h = H.link_hierarchies(_edges(spark, d), "from_function_id", "to_function_id")
    return H.descendant_counts(h).select(F.col("node").alias("function_id"), "descendants", "height")


@core.add("p3_multiple_parents", f"with recursive {_EDGES} select c function_id, count(*) parents, min(p) kept from e group by 1 having count(*) > 1")
def p3_multiple_parents(spark, d):
    """Functions with several callers: of those only the smallest is followed."""
    return H.multiple_parents(_edges(spark, d), "from_function_id", "to_function_id").select(F.col("node").alias("function_id"), "parents", "kept")


_FOLD = """list_reduce(list_prepend('', list_filter(string_split(replace({0}, '\\', '/'), '/'), lambda x: x <> '' and x <> '.')),
  lambda a, x: case when x = '..' then case when a = '' then '?out' else regexp_replace(a, '/?[^/]*$', '') end when a = '' then x else a || '/' || x end)"""

_DANGLING = f"""st as (select f.id, arg_max(project_id, last_scanned) project_id, arg_max(relative_path, last_scanned) rel, min(last_scanned) first_scan, max(last_scanned) last_scan,
   any_value(case when d.del >= x.last then d.del end) deleted_from
  from files f join (select id, max(last_scanned) last from files group by 1) x on x.id = f.id
  left join (select entity_id, max(deleted_at) del from deletions where entity = 'file' group by 1) d on d.entity_id = f.id group by f.id),
fn as (select distinct f.id, s.first_scan, s.deleted_from, g.gone from (select distinct id, file_id from function_defs) f left join st s on s.id = f.file_id
  left join (select entity_id, min(deleted_at) gone from deletions where entity = 'function' group by 1) g on g.entity_id = f.id),
dc as (select distinct c.id ref_id, detected_at moment, case when fn.id is null then 'missing' when gone <= detected_at or deleted_from <= detected_at then 'deleted' when detected_at < first_scan then 'late' end reason
  from calls c left join fn on fn.id = c.to_function_id),
tg as (select distinct i.id ref_id, s.project_id, s.last_scan moment, {_FOLD.format("coalesce(resolved_path, regexp_replace(s.rel, '[^/]*$', '') || source)")} t
  from imports i join st s on s.id = i.file_id where resolved_path is not null or source like '.%'),
cand as (select ref_id, project_id, moment, unnest(list_concat([t, regexp_replace(t, '\\.js$', '.ts'), regexp_replace(t, '\\.jsx$', '.tsx')],
  list_transform(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs'], lambda s: case when t = '' then ltrim(s, '/') else t || s end))) p from tg),
hit as (select ref_id, bool_or(s.id is not null and s.deleted_from is null) alive, bool_or(s.id is not null) known, any_value(moment) moment from cand left join st s on s.project_id = cand.project_id and s.rel = cand.p group by 1),
al as (select 'calls' ref_table, ref_id, moment, reason from dc where reason is not null
  union all select 'imports', ref_id, moment, case when known then 'deleted' else 'missing' end from hit where not alive)"""


def _dangling(spark, d):
    return R.dangling(*(table(spark, d, t) for t in ("files", "function_defs", "imports", "calls", "deletions")))


@core.add("p4_found", f"with {_DANGLING} select distinct ref_table, ref_id from al")
def p4_found(spark, d):
    return _dangling(spark, d).select("ref_table", "ref_id")


@core.add("p4_dangling", f"with {_DANGLING} select ref_table, ref_id, min(strftime(moment, '%Y-%m')) as month, min(reason) reason from al group by 1, 2")
def p4_dangling(spark, d):
    return _dangling(spark, d)


@core.add("p4_by_month", f"with {_DANGLING} select ref_table, strftime(moment, '%Y-%m') as month, reason, count(distinct ref_id) n from al group by 1, 2, 3")
def p4_by_month(spark, d):
    return _dangling(spark, d).groupBy("ref_table", "month", "reason").agg(F.count("*").alias("n"))
