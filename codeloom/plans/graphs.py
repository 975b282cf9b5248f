"""Queries of import resolution and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import dirname
from ..operators import graph as G
from ..operators import references as R
from ..operators import resolve as V
from ..sources.tables import table
from .integrity import _DANGLING
from .registry import core

_RES = (
    _DANGLING.split("dc as (")[0]
    + "tg as"
    + _DANGLING.split("tg as")[1].split("cand as")[0]
    + """cand as (select ref_id, project_id, generate_subscripts(l, 1) - 1 place, unnest(l) p from (select *, list_concat([t, case when t like '%.js' then regexp_replace(t, '\\.js$', '.ts') end, case when t like '%.jsx' then regexp_replace(t, '\\.jsx$', '.tsx') end],
  list_transform(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs'], lambda s: case when t = '' then ltrim(s, '/') else t || s end)) l from tg)),
rs as (select ref_id, arg_min(s.id, struct_pack(place := place, id := s.id)) resolved_id from cand join st s on s.project_id = cand.project_id and s.rel = cand.p group by 1),
ed as (select distinct i.file_id src, rs.resolved_id dst from imports i join rs on rs.ref_id = i.id where i.file_id is not null)"""
)


def states(spark, d):
    return R.file_states(table(spark, d, "files"), table(spark, d, "deletions"))


def resolved(spark, d):
    return V.resolve_imports(table(spark, d, "imports"), states(spark, d))


def edges(spark, d):
    return V.edges(resolved(spark, d))


@core.add("import_resolution", f"with {_RES} select distinct i.id ref_id, i.file_id, rs.resolved_id from imports i left join rs on rs.ref_id = i.id")
def import_resolution(spark, d):
    return resolved(spark, d).select("ref_id", "file_id", "resolved_id")


@core.add("import_resolution_rate", f"with {_RES}, i as (select distinct id, file_id, resolved from imports) select count(*) imports, count_if(resolved) said, count(rs.resolved_id) found from i left join rs on rs.ref_id = i.id")
def import_resolution_rate(spark, d):
    said = table(spark, d, "imports").select(F.col("id").alias("ref_id"), "resolved").distinct()
    return resolved(spark, d).join(said, "ref_id").agg(F.count("*").alias("imports"), F.count_if("resolved").alias("said"), F.count("resolved_id").alias("found"))


@core.add("imports_by_kind", "select coalesce(kind, 'unknown') as kind, count(*) n, count_if(resolved) resolved, count_if(not resolved and not starts_with(source, '.')) external from (select distinct * from imports) group by 1")
def imports_by_kind(spark, d):
    i = table(spark, d, "imports").distinct()
    return i.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved") & ~F.col("source").startswith(".")).alias("external"))


@core.add("top_unresolved", "select source, count(distinct id) n from imports where not resolved group by 1 order by 2 desc, 1 limit 10")
def top_unresolved(spark, d):
    return table(spark, d, "imports").where("not resolved").groupBy("source").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@core.add("dependents", f"with {_RES} select dst node, count(*) dependents from ed where src <> dst group by 1")
def dependents(spark, d):
    return G.dependents(edges(spark, d))


@core.add("dependency_subgraph", f"with {_RES} select src, dst from ed where src in (select id from st where rel like 'apps/%') and dst in (select id from st where rel like 'apps/%')")
def dependency_subgraph(spark, d):
    nodes = states(spark, d).where(F.startswith("relative_path", F.lit("apps/"))).select(F.col("id").alias("node"))
    return G.subgraph(edges(spark, d), nodes)


_WALK = "w as (select id seed, id node, 0 depth from st where id % 100 = 0 union select w.seed, ed.{1}, w.depth + 1 from w join ed on ed.{0} = w.node where w.depth < {2})"


def seeds(spark, d):
    return states(spark, d).where("id % 100 = 0").select(F.col("id").alias("seed"))


@core.add("trace_imports", f"with recursive {_RES}, {_WALK.format('src', 'dst', 10)} select seed, node, min(depth) depth from w where node <> seed group by 1, 2")
def trace_imports(spark, d):
    return G.walk(edges(spark, d), seeds(spark, d), 10)


@core.add("impact_analysis", f"with recursive {_RES}, {_WALK.format('dst', 'src', 5)}, m as (select seed, node, min(depth) depth from w where node <> seed group by 1, 2), g as (select seed, count_if(depth = 1) direct, count_if(depth = 2) medium, count_if(depth > 2) low, count(*) total from m group by 1) select *, case when direct > 5 then 'high' when direct > 2 or medium > 5 then 'medium' else 'low' end risk from g")
def impact_analysis(spark, d):
    return G.impact(edges(spark, d), seeds(spark, d))


@core.add("cycles_len3", f"""with {_RES}, e as (select * from ed where src <> dst), c as (select [src] c from ed where src = dst
 union select [a.src, a.dst] from e a join e b on a.dst = b.src and b.dst = a.src where a.src < a.dst
 union select [a.src, b.src, c.src] from e a join e b on a.dst = b.src join e c on b.dst = c.src and c.dst = a.src where a.src < b.src and a.src < c.src and b.src <> c.src)
 select array_to_string(c, '-') as cycle, cast(len(c) as int) length from c""")
def cycles_len3(spark, d):
    c = G.short_cycles(edges(spark, d), 3)
    return c.select(F.array_join(F.col("cycle").cast("array<string>"), "-").alias("cycle"), "length")


@core.add("mutual_imports", f"with {_RES} select x.src a, x.dst b from ed x join ed y on x.src = y.dst and x.dst = y.src where x.src < x.dst")
def mutual_imports(spark, d):
    return G.mutual(edges(spark, d))


def modules(spark, d):
    return states(spark, d).select(F.col("id").alias("node"), F.concat_ws(":", F.col("project_id").cast("string"), dirname(F.col("relative_path"))).alias("module"))


_MODS = "md as (select id node, project_id || ':' || regexp_replace(rel, '/?[^/]*$', '') as module from st), me as (select distinct x.module a, y.module b from ed join md x on x.node = ed.src join md y on y.node = ed.dst where x.module <> y.module)"


@core.add("coupling_metrics", f"""with {_RES}, {_MODS}, c as (select m.module, (select count(*) from me where b = m.module) ca, (select count(*) from me where a = m.module) ce from (select distinct module from md) m)
 select *, round(case when ca + ce = 0 then 0.0 else ce / (ca + ce) end, 6) instability, round(abs(case when ca + ce = 0 then 0.0 else ce / (ca + ce) end - 1), 6) distance, case when ca > 5 and ce > 5 then 'god' when ce = 0 and ca > 0 then 'leaf' else 'plain' end kind from c""")
def coupling_metrics(spark, d):
    return G.coupling(edges(spark, d), modules(spark, d))


@core.add("module_graph", f"with {_RES}, {_MODS} select x.module a, y.module b, count(*) links from ed join md x on x.node = ed.src join md y on y.node = ed.dst group by 1, 2")
def module_graph(spark, d):
    return G.module_edges(edges(spark, d), modules(spark, d))


#: Layers from the top; patterns are regular expressions common to both engines.
LAYERS = [("interface", 0, ["/cli/", "/commands/"]), ("domain", 1, ["/core/", "/generator/"]), ("support", 2, ["/utils/", "/lib/"]), ("storage", 3, ["/storage/"])]
_LAYER = "ly as (select id node, case when regexp_matches(rel, '/cli/|/commands/') then 0 when regexp_matches(rel, '/core/|/generator/') then 1 when regexp_matches(rel, '/utils/|/lib/') then 2 when regexp_matches(rel, '/storage/') then 3 end o from st), ln as (select node, ['interface', 'domain', 'support', 'storage'][o + 1] layer, o from ly where o is not null)"


def layers(spark, d):
    return G.first_layer(states(spark, d).select(F.col("id").alias("node"), F.col("relative_path").alias("path")), LAYERS)


@core.add("layer_assignment", f"with {_RES}, {_LAYER} select layer, count(*) files from ln group by 1")
def layer_assignment(spark, d):
    return layers(spark, d).where("layer is not null").groupBy("layer").agg(F.count("*").alias("files"))


@core.add("layer_violations", f"with {_RES}, {_LAYER}, v as (select src, x.layer l1, y.layer l2, y.o - x.o gap from ed join ln x on x.node = src join ln y on y.node = dst where y.o > x.o) select src, l1, count(*) imports, array_to_string(list_sort(list_distinct(list(l2))), ',') layers, case when bool_or(gap > 1) then 'error' else 'warning' end severity from v group by 1, 2")
def layer_violations(spark, d):
    return G.layer_violations(edges(spark, d), layers(spark, d))
