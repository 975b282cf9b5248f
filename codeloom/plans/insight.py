"""Queries of graphs in full, findings about files, and reports on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.paths import module_of
from ..functions.scalars import layer_glob_regex, percent
from ..operators import advice as A
from ..operators import composite as X
from ..operators import debt as D
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import resolve as V
from ..operators import rules as R
from ..sources.sinks import html_table, markdown_table
from ..sources.tables import table
from .graphs import _MODS, _RES, edges, modules, resolved, seeds, states
from .records import _DEBT, debt, patterns
from .registry import core
from .reports import _MOD, _REL, CUR, _churn, _CHURN, cur
from .texts import _COH, _L, _T, CONTRACTS, coherence_fast, texts

# ---------------------------------------------------------------- graphs

_STEPS = "w as (select id seed, id node, 0 depth from st where id % 100 = 0 union select w.seed, ed.dst, w.depth + 1 from w join ed on ed.src = w.node where w.depth < 10), m as (select seed, node, min(depth) depth from w group by 1, 2), pp as (select seed, node, [seed] path from m where depth = 0 union all select pp.seed, m.node, list_append(pp.path, m.node) from pp join ed on ed.src = pp.node join m on m.seed = pp.seed and m.node = ed.dst and m.depth = len(pp.path))"


@core.add("trace_paths", f"with recursive {_RES}, {_STEPS} select seed, node, cast(min(len(path)) - 1 as int) depth, array_to_string(min(path), '>') path from pp where node <> seed group by 1, 2")
def trace_paths(spark, d):
    w = G.walk_paths(edges(spark, d), seeds(spark, d), 10)
    return w.select("seed", "node", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


_RINGS = "cl as (select src a, dst b from ed union select cl.a, ed.dst from cl join ed on ed.src = cl.b), sc as (select x.a node, least(x.a, min(x.b)) ring from cl x join cl y on x.a = y.b and x.b = y.a group by 1), sz as (select ring, count(*) size from sc group by 1)"


@core.add("cycles_all", f"with recursive {_RES}, {_RINGS} select node, sc.ring, size from sc join sz on sz.ring = sc.ring")
def cycles_all(spark, d):
    """Files on an import cycle of any length, with the ring they belong to."""
    return G.rings(edges(spark, d))


@core.add("call_rings", "with recursive ed as (select distinct from_function_id src, to_function_id dst from calls where from_function_id is not null and to_function_id is not null), cl as (select src a, dst b from ed union select cl.a, ed.dst from cl join ed on ed.src = cl.b), sc as (select x.a node, least(x.a, min(x.b)) ring from cl x join cl y on x.a = y.b and x.b = y.a group by 1) select ring, count(*) size from sc group by 1")
def call_rings(spark, d):
    c = table(spark, d, "calls").select(F.col("from_function_id").alias("src"), F.col("to_function_id").alias("dst"))
    return G.rings(c).select("ring", "size").distinct()


_C3 = """e as (select * from ed where src <> dst), cy as (select [src] c from ed where src = dst
 union select [a.src, a.dst] from e a join e b on a.dst = b.src and b.dst = a.src where a.src < a.dst
 union select [a.src, b.src, c.src] from e a join e b on a.dst = b.src join e c on b.dst = c.src and c.dst = a.src where a.src < b.src and a.src < c.src and b.src <> c.src)"""


@core.add("cycles_of_files", f"with {_RES}, {_C3} select unnest(c) node, array_to_string(c, '-') as cycle, cast(len(c) as int) length from cy")
def cycles_of_files(spark, d):
    c = G.cycles_of(G.short_cycles(edges(spark, d), 3))
    return c.select("node", F.array_join(F.col("cycle").cast("array<string>"), "-").alias("cycle"), "length")


@core.add("drift_items", f"with {_RES}, {_C3}, u as (select c, generate_subscripts(l, 1) n, unnest(l) id from (select c, list_append(c, c[1]) l from cy)) select 'architectural_drift' as type, 'high' severity, 'Circular dependency detected: ' || string_agg(st.rel, ' -> ' order by n) description from u join st on st.id = u.id group by c")
def drift_items(spark, d):
    """A debt item for each cycle, its files by name, the first repeated at the end."""
    c = G.short_cycles(edges(spark, d), 3).select("cycle", F.posexplode(F.concat("cycle", F.slice("cycle", 1, 1))).alias("n", "id"))
    named = c.join(states(spark, d).select("id", "relative_path"), "id").groupBy("cycle").agg(F.array_sort(F.collect_list(F.struct("n", "relative_path"))).alias("p"))
    return named.select(F.lit("architectural_drift").alias("type"), F.lit("high").alias("severity"), F.concat(F.lit("Circular dependency detected: "), F.array_join(F.transform("p", lambda x: x["relative_path"]), " -> ")).alias("description"))


@core.add("pattern_drift_items", f"with {_COH} select path, 'pattern_drift' as type, case when f or issues > 2 then 'high' else 'medium' end severity from co where f or issues > 0")
def pattern_drift_items(spark, d):
    c = coherence_fast(spark, d).where("verdict <> 'pass'")
    return c.select("path", F.lit("pattern_drift").alias("type"), F.when(F.col("verdict") == "fail", "high").otherwise("medium").alias("severity"))


_DIRS = "dr as (select distinct project_id, regexp_replace(rel, '/?[^/]*$', '') dir from st)"


@core.add("module_nesting", f"with {_RES}, {_DIRS}, k as (select project_id || ':' || dir as module from dr where project_id is not null and dir <> '') select x.module a, y.module b from k x join k y on starts_with(x.module, y.module || '/')")
def module_nesting(spark, d):
    m = modules(spark, d).select("module").where(~F.col("module").endswith(":"))
    return G.nested_modules(m)


_SRC = "im as (select distinct s.project_id, i.file_id, i.resolved_path source from imports i join st s on s.id = i.file_id where i.resolved_path is not null)"


@core.add("dependents_by_source", f"with {_RES}, {_DIRS}, {_SRC} select dr.project_id, dr.dir as target, count(distinct im.file_id) dependents from im join dr on dr.project_id = im.project_id and (im.source = dr.dir or starts_with(im.source, dr.dir || '/')) where dr.dir <> '' group by 1, 2")
def dependents_by_source(spark, d):
    from ..functions.paths import dirname

    s = states(spark, d)
    i = table(spark, d, "imports").where("resolved_path is not null").select("file_id", F.col("resolved_path").alias("source")).join(s.select(F.col("id").alias("file_id"), "project_id"), "file_id")
    return G.dependents_by_source(i, s.select("project_id", dirname(F.col("relative_path")).alias("target")).where("target <> ''"))


@core.add("dependents_of_sources", "select source, count(distinct file_id) dependents from imports where source is not null group by 1")
def dependents_of_sources(spark, d):
    return table(spark, d, "imports").where("source is not null").groupBy("source").agg(F.count_distinct("file_id").alias("dependents"))


ALIASES = [("@/", "src/"), ("#", "lib/")]
_ALIAS = _RES.replace("coalesce(resolved_path, ", "coalesce(resolved_path, case when source like '@/%' then 'src/' || substr(source, 3) when source like '#%' then 'lib/' || substr(source, 2) end, ").replace("source like '.%'", "source like '.%' or source like '@/%' or source like '#%'")


@core.add("import_resolution_aliases", f"with {_ALIAS} select distinct i.id ref_id, i.file_id, rs.resolved_id from imports i left join rs on rs.ref_id = i.id")
def import_resolution_aliases(spark, d):
    return V.resolve_imports(V.with_aliases(table(spark, d, "imports"), ALIASES), states(spark, d)).select("ref_id", "file_id", "resolved_id")


def _way(sql: str) -> str:
    """The targets of all sources, taken in one way, and the files that they find."""
    from .integrity import _FOLD

    return f"select i.id ref_id, s.project_id, {_FOLD.format(sql)} t from (select distinct id, file_id, source from imports where source is not null) i join st s on s.id = i.file_id"


_TRY = """(select ref_id, project_id, generate_subscripts(l, 1) - 1 place, unnest(l) p from (select *, list_concat([t, case when t like '%.js' then regexp_replace(t, '\\.js$', '.ts') end, case when t like '%.jsx' then regexp_replace(t, '\\.jsx$', '.tsx') end],
  list_transform(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs'], lambda s: case when t = '' then ltrim(s, '/') else t || s end)) l from ({0})))"""


@core.add("path_resolution", f"with {_RES}, ba as (select ref_id, arg_min(s.id, struct_pack(place := place, id := s.id)) id from {_TRY.format(_way('source'))} c join st s on s.project_id = c.project_id and s.rel = c.p group by 1), re as (select ref_id, arg_min(s.id, struct_pack(place := place, id := s.id)) id from {_TRY.format(_way('regexp_replace(s.rel, ' + chr(39) + '[^/]*$' + chr(39) + ', ' + chr(39) * 2 + ') || source'))} c join st s on s.project_id = c.project_id and s.rel = c.p group by 1) select distinct i.id ref_id, coalesce(ba.id, re.id) resolved_id, case when ba.id is not null then 'bare' when re.id is not null then 'relative' end way from imports i left join ba on ba.ref_id = i.id left join re on re.ref_id = i.id where i.source is not null")
def path_resolution(spark, d):
    refs = table(spark, d, "imports").where("source is not null").select(F.col("id").alias("ref_id"), "file_id", "source")
    return V.resolve_anyhow(refs, states(spark, d))


@core.add("project_mermaid", f"with {_RES}, {_MODS}, g as (select x.module a, y.module b, count(*) links from ed join md x on x.node = ed.src join md y on y.node = ed.dst group by 1, 2) select a as module, '  ' || regexp_replace(a, '[^A-Za-z0-9]', '_', 'g') || ' -->|' || links || '| ' || regexp_replace(b, '[^A-Za-z0-9]', '_', 'g') line from g")
def project_mermaid(spark, d):
    """The module graph in Mermaid notation, a row a line: any number of lines, in no one task."""
    return G.mermaid_lines(G.module_edges(edges(spark, d), modules(spark, d)))


LAYER_GLOBS = [("tests", 0, ["**/tests/**", "**/*.test.*"]), ("interface", 1, ["apps/*/cli/**", "**/commands/*"]), ("library", 2, ["**/lib/**"])]


@core.add("layers_by_glob", f"with {_RES} select id node, case when regexp_matches(rel, '^.[^/]*/tests/.[^/]*$') or regexp_matches(rel, '^.[^/]*/[^/]*.test.[^/]*$') then 'tests' when regexp_matches(rel, '^apps/[^/]*/cli/.[^/]*$') or regexp_matches(rel, '^.[^/]*/commands/[^/]*$') then 'interface' when regexp_matches(rel, '^.[^/]*/lib/.[^/]*$') then 'library' end layer from st")
def layers_by_glob(spark, d):
    layers = [(n, o, [layer_glob_regex(g) for g in gs]) for n, o, gs in LAYER_GLOBS]
    return G.first_layer(states(spark, d).select(F.col("id").alias("node"), F.col("relative_path").alias("path")), layers).select("node", "layer")


# ---------------------------------------------------------------- findings


@core.add("repeated_signatures", "with f as (select distinct id, file_id, trim(regexp_replace(coalesce(signature, ''), '\\s+', ' ', 'g')) signature from function_defs) select file_id, signature, count(*) - 1 repeats from f group by 1, 2 having count(*) > 1")
def repeated_signatures(spark, d):
    return A.repeated_signatures(table(spark, d, "function_defs"))


_SUG = f"""{_RES}, {CUR}, f as (select distinct id, file_id, name, trim(regexp_replace(coalesce(signature, ''), '\\s+', ' ', 'g')) sig, complexity from function_defs),
ev as (select distinct name, sig, file_id from f where name is not null and file_id is not null),
ot as (select x.file_id, x.name, x.sig, count(distinct y.file_id) n from ev x join ev y on y.name = x.name and y.sig <> x.sig and y.file_id <> x.file_id group by 1, 2, 3),
im as (select file_id, count_if(resolved_id is null) ext, count_if(contains(source, '../')) up from (select distinct i.id, i.file_id, i.source, rs.resolved_id from imports i left join rs on rs.ref_id = i.id) group by 1),
sg as (select file_id, 'complexity' as type, case when complexity > 20 then 'high' else 'medium' end priority, name subject, cast(complexity as double) amount from f where complexity > 10
 union all select id, 'complexity', 'high', null, cognitive_load from cur where cognitive_load > 0.7
 union all select file_id, 'duplication', 'medium', sig, count(*) - 1 from (select distinct id, file_id, sig from f) group by file_id, sig having count(*) > 1
 union all select file_id, 'duplication', 'low', name, n from ot
 union all select file_id, 'architecture', 'medium', null, ext from im where ext > 10
 union all select file_id, 'architecture', 'low', null, up from im where up > 3
 union all select id, 'consistency', 'low', null, null from cur where not coalesce(agent_touched, false))"""


def suggestions(spark, d):
    found = resolved(spark, d).select(F.col("ref_id").alias("id"), "resolved_id").distinct()
    i = table(spark, d, "imports").select("id", "file_id", "source").distinct().join(found, "id", "left")
    return A.suggestions(cur(spark, d, "cognitive_load", "agent_touched"), table(spark, d, "function_defs"), i)


@core.add("refactor_suggestions", f"with {_SUG} select file_id, type, priority, subject, amount, case priority when 'high' then 0 when 'medium' then 1 else 2 end as rank from sg")
def refactor_suggestions(spark, d):
    return suggestions(spark, d)


@core.add("suggestion_counts", f"with {_SUG} select type, priority, count(*) n from sg group by 1, 2")
def suggestion_counts(spark, d):
    return suggestions(spark, d).groupBy("type", "priority").agg(F.count("*").alias("n"))


_CAND = f"""{_DEBT}, {CUR}, t as (select user_id file_id, count(*) churn from events group by 1), i as (select file_id, count(distinct id) imports from imports group by 1),
b as (select file_id, count(*) items, count_if(type = '1-URGENT') redundancy, count_if(type = '2-HIGH') drift from debt where not resolved group by 1),
f as (select c.id, cast(floor(coalesce(size_bytes, 0) / 20 + 0.5) as bigint) lines, coalesce(cognitive_load, 0.0) load, coalesce(churn, 0) churn, coalesce(imports, 0) imports, coalesce(items, 0) items, coalesce(redundancy, 0) redundancy, coalesce(drift, 0) drift from cur c left join t on t.file_id = c.id left join i on i.file_id = c.id left join b on b.file_id = c.id),
g as (select * from f where items > 0 or load >= 0.2),
u as (select id, 'extract-function' kind, least(lines / 50, 8.0) effort, 0.3 red, churn from g where load > 0.5 or lines > 300
 union all select id, 'extract-class', least(lines / 100, 16.0), 0.4, churn from g where load > 0.7 and lines > 500
 union all select id, 'simplify', least(redundancy * 2, 8), 0.35, churn from g where redundancy > 0
 union all select id, 'rename', least(drift, 4), 0.25, churn from g where drift > 0
 union all select id, 'move', 4, 0.3, churn from g where churn > 5 and load > 0.3
 union all select id, 'inline', 2, 0.15, churn from g where lines < 50 and imports > 5),
r as (select id, kind, cast(effort as double) effort, coalesce(cast(red as double) * churn / nullif(cast(effort as double), 0), 0.0) raw from u),
cd as (select id, kind, floor(effort * 10 + 0.5) / 10 effort, floor(raw * 100 + 0.5) / 100 roi, case when raw > 3 then 'critical' when raw > 1.5 then 'high' when raw > 0.8 then 'medium' else 'low' end priority from r)"""


def candidates(spark, d):
    churn = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("churn"))
    i = table(spark, d, "imports").groupBy(F.col("file_id").alias("id")).agg(F.count_distinct("id").alias("imports"))
    b = debt(spark, d).where("not resolved").groupBy("file_id").agg(F.count("*").alias("items"), F.count_if(F.col("type") == "1-URGENT").alias("redundancy"), F.count_if(F.col("type") == "2-HIGH").alias("drift"))
    f = cur(spark, d, "size_bytes", "cognitive_load").withColumn("lines", F.floor(F.coalesce("size_bytes", F.lit(0)) / 20 + 0.5))
    return A.refactor_candidates(f.join(churn, "id", "left").join(i, "id", "left"), b)


@core.add("refactor_candidates", f"with {_CAND} select * from cd")
def refactor_candidates(spark, d):
    return candidates(spark, d)


@core.add("roi_summary", f"with {_CAND} select count(*) candidates, round(sum(effort), 1) effort, round(coalesce(avg(roi), 0.0), 4) average_roi, count_if(priority = 'critical') critical, count_if(priority = 'high') high, count_if(priority = 'medium') medium, count_if(priority = 'low') low from cd")
def roi_summary(spark, d):
    return A.roi_summary(candidates(spark, d))


@core.add("roi_top20", f"with {_CAND} select id, kind, roi, priority from cd order by roi desc, id, kind limit 20")
def roi_top20(spark, d):
    return candidates(spark, d).orderBy(F.desc("roi"), "id", "kind").limit(20).select("id", "kind", "roi", "priority")


@core.add("patterns_by_category", "with f as (select distinct id, name from function_defs), p as (select md5(name) code_hash, case when regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') then 'camelCase' when regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') then 'PascalCase' when regexp_matches(name, '^[a-z][a-z0-9_]*$') then 'snake_case' when regexp_matches(name, '^[A-Z][A-Z0-9_]*$') then 'SCREAMING_SNAKE' else 'unknown' end pattern, count(*) usage_count, max(id) last_id from f group by 1, 2) select code_hash, usage_count, last_id from p where pattern = 'camelCase' order by usage_count desc, last_id desc limit 20")
def patterns_by_category(spark, d):
    return patterns(spark, d).where("pattern = 'camelCase'").orderBy(F.desc("usage_count"), F.desc("last_id")).limit(20).select("code_hash", "usage_count", "last_id")


SINCE = "2025-06-01"
_CHG = f"{CUR}, ch as (select id, project_id || ':' || {_MOD} as module, relative_path, agent_touched, cognitive_load from cur where last_scanned >= timestamp '{SINCE}')"


def changed(spark, d):
    return with_module(cur(spark, d)).where(f"last_scanned >= timestamp_ntz'{SINCE}'")


def with_module(files):
    return files.withColumn("module", F.concat_ws(":", F.col("project_id").cast("string"), module_of(F.col("relative_path")))).where("project_id is not null")


@core.add("pr_tests", f"with {_CHG} select module, regexp_replace(regexp_replace(replace(relative_path, 'src/', 'tests/'), '\\.ts$', '.test.ts'), '\\.js$', '.test.js') test from ch where module is not null union select c.project_id || ':' || {_MOD}, relative_path from cur c where (contains(relative_path, '.test.') or contains(relative_path, '.spec.')) and c.project_id || ':' || {_MOD} in (select module from ch)")
def pr_tests(spark, d):
    return A.tests_for(changed(spark, d), with_module(cur(spark, d, "project_id", "relative_path")))


@core.add("pr_breaking", f"with {_CHG} select relative_path, 'public-api' reason from ch where agent_touched and module is not null union select relative_path, 'core-types' from ch where module is not null and (contains(relative_path, 'index.ts') or contains(relative_path, 'types.ts') or contains(relative_path, 'contracts'))")
def pr_breaking(spark, d):
    return A.breaking_changes(changed(spark, d))


@core.add("pr_modules", f"with {_CHG} select module, count(*) files, case when max(coalesce(cognitive_load, 0)) > 0.5 then 'high' when max(coalesce(cognitive_load, 0)) > 0.2 then 'medium' else 'low' end risk from ch where module is not null group by 1")
def pr_modules(spark, d):
    worst = F.max(F.coalesce("cognitive_load", F.lit(0.0)))
    return changed(spark, d).groupBy("module").agg(F.count("*").alias("files"), F.when(worst > 0.5, "high").when(worst > 0.2, "medium").otherwise("low").alias("risk"))


_STRAT = " union all ".join(f"select '{n}' strategy, id, project_id, tokens, {o} o from rel" for n, o in (("relevance", "relevance"), ("diversity", "priority"), ("coverage", "cast(tokens as double)"), ("hybrid", "relevance * 0.6 + priority * 0.4")))
_BUDGET = f"{_REL}, sr as ({_STRAT}), rk as (select *, row_number() over (partition by strategy, project_id order by o desc, id) n from sr where tokens <= 2000), go as (select strategy, project_id, n, tokens used, true taken, id from rk where n = 1 union all select r.strategy, r.project_id, r.n, case when g.used + r.tokens <= 2000 then g.used + r.tokens else g.used end, g.used + r.tokens <= 2000, r.id from go g join rk r on r.strategy = g.strategy and r.project_id = g.project_id and r.n = g.n + 1)"


@core.add("context_budget_strategies", f"with recursive {_BUDGET}, al as (select strategy, project_id, count(*) candidates, bool_or(tokens > 1000) large from sr where project_id is not null group by 1, 2), s as (select al.strategy, al.project_id, candidates, large, coalesce(selected, 0) selected, coalesce(used, 0) used from al left join (select strategy, project_id, count(*) selected, max(used) used from go where taken group by 1, 2) g on g.strategy = al.strategy and g.project_id = al.project_id) select strategy, project_id, candidates, selected, cast(used as bigint) used, round(used / 2000, 4) utilization, array_to_string(list_filter([case when used / 2000 < 0.5 then 'underutilized' end, case when used / 2000 > 0.95 then 'exhausted' end, case when selected < 5 and candidates > 10 then 'few-selected' end, case when large then 'large-files' end], lambda x: x is not null), ',') recommendations from s")
def context_budget_strategies(spark, d):
    """Every way to choose within a budget, over all files of each project."""
    rel = M.relevance(cur(spark, d), "trace a cache").where("project_id is not null")
    out = None
    for name in M.STRATEGIES:
        one = M.budget_report(rel, 2000, name)
        out = one if out is None else out.unionByName(one)
    return out


@core.add("file_context", f"with {_RES}, {CUR}, i as (select file_id, count(distinct id) n from imports group by 1), f as (select file_id, count(distinct id) n, max(complexity) worst from function_defs group by 1), dp as (select dst, count(*) n from ed where src <> dst group by 1), mu as (select x.src, count(*) n from ed x join ed y on x.src = y.dst and x.dst = y.src where x.src <> x.dst group by 1) select c.id, c.relative_path, coalesce(i.n, 0) imports, coalesce(f.n, 0) functions, f.worst, coalesce(dp.n, 0) dependents, coalesce(mu.n, 0) mutual from cur c left join i on i.file_id = c.id left join f on f.file_id = c.id left join dp on dp.dst = c.id left join mu on mu.src = c.id")
def file_context(spark, d):
    """What is known about each file: its imports, functions, dependents and mutual imports."""
    from ..session import cut

    e = cut(edges(spark, d))
    i = table(spark, d, "imports").groupBy(F.col("file_id").alias("id")).agg(F.count_distinct("id").alias("imports"))
    f = table(spark, d, "function_defs").groupBy(F.col("file_id").alias("id")).agg(F.count_distinct("id").alias("functions"), F.max("complexity").alias("worst"))
    mutual = G.mutual(e).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("mutual"))
    j = cur(spark, d, "relative_path").join(i, "id", "left").join(f, "id", "left").join(G.dependents(e).withColumnRenamed("node", "id"), "id", "left").join(mutual, "id", "left")
    return j.na.fill(0, ["imports", "functions", "dependents", "mutual"]).select("id", "relative_path", "imports", "functions", "worst", "dependents", "mutual")


_TARGET = f"{CUR}, tg0 as (select * from cur where contains(relative_path, 'index.ts') order by id limit 1), tg1 as (select id, project_id || ':' || {_MOD} as module from tg0), md1 as (select c.id, c.project_id || ':' || {_MOD} as module, coalesce(cognitive_load, 0.0) load from cur c)"


@core.add("impact_listing", f"with {_TARGET} select * from (select 'module' part, md1.id, load from md1 join tg1 on tg1.module = md1.module and md1.id <> tg1.id order by md1.id limit 20) union all select * from (select 'high-load', md1.id, load from md1 where load > 0.4 and id not in (select id from tg1) order by md1.load desc, md1.id limit 10)")
def impact_listing(spark, d):
    """Of the first file that a name fits: 20 files of its module and the 10 heaviest others."""
    f = with_module(cur(spark, d)).select("id", "module", "relative_path", F.coalesce("cognitive_load", F.lit(0.0)).alias("load"))
    target = f.where(M.names_meet(F.col("relative_path"), "index.ts")).orderBy("id").limit(1).select(F.col("id").alias("own"), "module")
    near = f.join(F.broadcast(target), "module").where("id <> own").orderBy("id").limit(20)
    heavy = f.join(F.broadcast(target.select("own")), F.col("id") == F.col("own"), "left_anti").where("load > 0.4").orderBy(F.desc("load"), "id").limit(10)
    return near.select(F.lit("module").alias("part"), "id", "load").unionByName(heavy.select(F.lit("high-load").alias("part"), "id", "load"))


# ---------------------------------------------------------------- reports


@core.add("module_files", f"with {CUR} select project_id, {_MOD} as module, id, relative_path from cur")
def module_files(spark, d):
    """The files of each module, as rows."""
    return cur(spark, d, "project_id", "relative_path").select("project_id", module_of(F.col("relative_path")).alias("module"), "id", "relative_path")


@core.add("language_top8", f"with {CUR} select coalesce(language, 'unknown') as language, count(*) files, round(sum(coalesce(size_bytes, 0)) / 1000, 3) kilobytes from cur group by 1 order by sum(coalesce(size_bytes, 0)) desc, 1 limit 8")
def language_top8(spark, d):
    b = M.language_breakdown(cur(spark, d, "language", "size_bytes")).orderBy(F.desc("bytes"), "language").limit(8)
    return b.select("language", "files", F.round(F.col("bytes") / 1000, 3).alias("kilobytes"))


@core.add("coverage_percent", f"with {CUR} select language, printf('%.1f%%', 100.0 * count_if(agent_touched) / count(*)) covered from cur where language is not null group by 1")
def coverage_percent(spark, d):
    f = cur(spark, d, "language", "agent_touched").where("language is not null")
    return f.groupBy("language").agg(percent(F.count_if("agent_touched") / F.count("*")).alias("covered"))


@core.add("debt_by_type", f"with {_DEBT} select type, count(*) n, count_if(resolved) done, count_if(severity = 'high') high from debt group by 1")
def debt_by_type(spark, d):
    return debt(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.count_if("resolved").alias("done"), F.count_if(F.col("severity") == "high").alias("high"))


@core.add("rest_report", f"with {_DEBT}, {CUR}, h as (select relative_path, coalesce(cognitive_load, 0.0) load from cur order by 2 desc, id limit 10) select (select count(*) from cur) total_files, (select count(*) from debt where not resolved and severity = 'high') high, (select count(*) from debt where not resolved and severity = 'medium') medium, (select count(*) from debt where not resolved and severity = 'low') low, (select round(max(load), 6) from h) worst, (select count(*) from h) hotspots")
def rest_report(spark, d):
    s = D.severities(debt(spark, d))
    f = cur(spark, d, "relative_path", "cognitive_load")
    h = M.hotspots(f).agg(F.round(F.max("load"), 6).alias("worst"), F.count("*").alias("hotspots"))
    return f.agg(F.count("*").alias("total_files")).crossJoin(s).crossJoin(h)


@core.add("skill_gap_tally", f"with {CUR}, lv as (select agent_touched_by agent, language skill, least(count(*) / 20.0, 1.0) lev from cur where agent_touched and agent_touched_by is not null and language in ('typescript', 'python', 'go') group by 1, 2), sk as (select unnest(['typescript', 'python', 'go']) skill, unnest([0.9, 0.7, 0.5]) importance), ag as (select distinct agent_touched_by agent from cur where agent_touched and agent_touched_by is not null), g as (select round(cast(s.importance as double) - coalesce(cast(lv.lev as double), 0.0), 6) gap, importance from ag a cross join sk s left join lv on lv.agent = a.agent and lv.skill = s.skill) select case when gap > 0.5 and importance > 0.8 then 'critical' when gap > 0.4 then 'high' when gap > 0.25 then 'medium' else 'low' end priority, count(*) n, round(max(gap), 6) worst from g where gap >= 0.3 group by 1")
def skill_gap_tally(spark, d):
    from .analysis import skill_gaps

    return skill_gaps(spark, d).groupBy("priority").agg(F.count("*").alias("n"), F.round(F.max("gap"), 6).alias("worst"))


def _q(p):
    return p.replace("'", "''")


_TEST = f"{_T}, x as (select path, content, len(regexp_extract_all(content, '(it|test)\\s*\\(\\s*[''\"`]')) + len(regexp_extract_all(content, 'describe\\s*\\(\\s*[''\"`]')) + len(regexp_extract_all(content, 'it\\s*\\(\\s*[''\"`]')) + len(regexp_extract_all(content, 'it\\([''\"`]')) tests, len(regexp_extract_all(content, 'expect\\s*\\(')) + len(regexp_extract_all(content, 'assert\\s*\\.')) + len(regexp_extract_all(content, 'should\\s*\\.')) + len(regexp_extract_all(content, '\\.toBe\\s*\\(')) + len(regexp_extract_all(content, '\\.toEqual\\s*\\(')) + len(regexp_extract_all(content, '\\.toContain\\s*\\(')) + len(regexp_extract_all(content, '\\.toHaveLength\\s*\\(')) assertions from tx where content is not null and (contains(path, '.test.') or contains(path, '.spec.') or contains(path, '/tests/'))), k as (select *, case when contains(content, 'jest') then 'jest' when contains(content, 'playwright') then 'playwright' when contains(content, 'cypress') then 'cypress' when contains(content, 'mocha') then 'mocha' else 'vitest' end framework, case when contains(content, 'e2e') or contains(content, 'playwright') or contains(content, 'cypress') then 'e2e' when contains(content, 'integration') or contains(content, '.int.') then 'integration' when contains(content, 'component') then 'component' else 'unit' end as type from x)"


@core.add("test_kinds", f"with {_TEST} select path, framework, type from k")
def test_kinds(spark, d):
    return R.test_kinds(texts(spark, d))


@core.add("test_totals", f"with {_TEST} select framework, type, count(*) files, cast(sum(tests) as bigint) tests, cast(sum(assertions) as bigint) assertions, count_if(tests > 0 and assertions < tests * 1.5) weak, count_if(tests = 0) empty from k group by 1, 2")
def test_totals(spark, d):
    t = texts(spark, d)
    j = R.test_quality(t).join(R.test_kinds(t), "path")
    return j.groupBy("framework", "type").agg(F.count("*").alias("files"), F.sum("tests").alias("tests"), F.sum("assertions").alias("assertions"), F.count_if("weak").alias("weak"), F.count_if(F.col("tests") == 0).alias("empty"))


@core.add("doc_tags", f"with {_T}, x as (select path, regexp_extract(content, '/\\*\\*([\\s\\S]*?)\\*/', 1) doc from tx) select path, nullif(regexp_extract(doc, '@since\\s+(\\S+)', 1), '') since, contains(doc, '@deprecated') deprecated, len(doc) doc_length from x where doc <> ''")
def doc_tags(spark, d):
    return R.doc_tags(texts(spark, d))


@core.add("config_flags", f"with {_T}, x as (select path, regexp_extract_all(content, '(\\w+)\\s*:\\s*\\{{[\\s\\S]*?enabled\\s*:\\s*(true|false)', 1) n, regexp_extract_all(content, '(\\w+)\\s*:\\s*\\{{[\\s\\S]*?enabled\\s*:\\s*(true|false)', 2) v from tx where contains(path, 'config') or contains(path, 'flag') or contains(path, 'feature')) select path, unnest(n) flag, unnest(v) = 'true' default_on from x")
def config_flags(spark, d):
    return R.config_flags(texts(spark, d))


@core.add("names_referenced", f"with {_T}, w as (select path, unnest(regexp_split_to_array(content, '[^A-Za-z0-9_]+')) as flag from tx), g as (select flag, count(distinct path) texts, count(*) refs from w group by 1), f as (select distinct name as flag from function_defs) select f.flag, coalesce(texts, 0) texts, coalesce(refs, 0) refs from f left join g on g.flag = f.flag")
def names_referenced(spark, d):
    """In how many texts each name of a function stands as a word, over all names."""
    return R.flag_references(table(spark, d, "function_defs").select(F.col("name").alias("flag")), texts(spark, d))


@core.add("names_unused", f"with {_T}, w as (select unnest(regexp_split_to_array(content, '[^A-Za-z0-9_]+')) as flag from tx), g as (select distinct flag from w), f as (select distinct name as flag from function_defs where name is not null) select count(*) names, count_if(g.flag is null) unused from f left join g on g.flag = f.flag")
def names_unused(spark, d):
    r = R.flag_references(table(spark, d, "function_defs").where("name is not null").select(F.col("name").alias("flag")), texts(spark, d))
    return r.agg(F.count("*").alias("names"), F.count_if(F.col("refs") == 0).alias("unused"))


@core.add("contracts_imports", f"with {_L} select path, 'no-storage' contract, 'error' severity, 'forbidden_import' kind, cast(line_number as int) line_number from ln where regexp_matches(path, '(?i)^(?:.*/)?[^/]*\\.(?:ts)$') and contains(line, 'utils/') and regexp_matches(line, 'import\\b|require\\s*\\(|\\bfrom\\b')")
def contracts_imports(spark, d):
    return R.contracts(texts(spark, d), [{"id": "no-storage", "glob": "**/*.ts", "forbidden_imports": ["utils/"], "severity": "error"}])


@core.add("api_changes", f"with {_RES}, s as (select f.id, f.name, st.first_scan < timestamp '2025-01-01' old, not exists (select 1 from deletions d where d.entity = 'function' and d.entity_id = f.id) and st.deleted_from is null live from (select distinct id, name, file_id from function_defs) f join st on st.id = f.file_id where f.name is not null) select id, name, case when old then 'removed' else 'added' end change, old breaking from s where old <> live")
def api_changes(spark, d):
    """What the deletion log and files that came since have changed among the functions of before 2025."""
    s = states(spark, d).select(F.col("id").alias("file_id"), "first_scan", "deleted_from")
    f = table(spark, d, "function_defs").where("name is not null").select("id", "name", "file_id").distinct().join(s, "file_id").withColumn("sig", F.lit(""))
    gone = table(spark, d, "deletions").where("entity = 'function'").select(F.col("entity_id").alias("id")).distinct()
    base = f.where("first_scan < timestamp_ntz'2025-01-01'")
    now = f.where("deleted_from is null").join(gone, "id", "left_anti")
    return R.api_diff(base, now, ["id", "name"], "sig")


@core.add("churn_risk30", f"with {_CHURN} select id, churn, risk from ch where churn > 0 or risk > 0.1 order by risk desc, churn desc, id limit 30")
def churn_risk30(spark, d):
    return _churn(spark, d).orderBy(F.desc("risk"), F.desc("churn"), "id").limit(30).select("id", "churn", "risk")


@core.add("instability_top20", f"with {_RES}, {_MODS}, c as (select m.module, (select count(*) from me where b = m.module) ca, (select count(*) from me where a = m.module) ce from (select distinct module from md) m) select module, ca, ce, round(case when ca + ce = 0 then 0.0 else ce / (ca + ce) end, 6) instability from c order by 4 desc, 1 limit 20")
def instability_top20(spark, d):
    return G.coupling(edges(spark, d), modules(spark, d)).select("module", "ca", "ce", "instability").orderBy(F.desc("instability"), "module").limit(20)


_ABS = "ex as (select s.project_id || ':' || regexp_replace(s.rel, '/?[^/]*$', '') as module, len(regexp_extract_all(content, 'export\\s+interface\\s+(\\w+)')) + len(regexp_extract_all(content, 'export\\s+type\\s+(\\w+)\\s*=')) abs, len(regexp_extract_all(content, 'export\\s+(?:async\\s+)?function\\s+(\\w+)\\s*\\(')) + len(regexp_extract_all(content, 'export\\s+(?:abstract\\s+)?class\\s+(\\w+)')) con from cur c join st s on s.id = c.id join tx on tx.path = c.path), ab as (select module, sum(abs) / nullif(sum(abs) + sum(con), 0) a from ex group by 1)"


@core.add("coupling_abstractness", f"with {_RES}, {_MODS}, {CUR}, {_T}, {_ABS}, c as (select m.module, (select count(*) from me where b = m.module) ca, (select count(*) from me where a = m.module) ce from (select distinct module from md) m), k as (select c.module, coalesce(a, 0.0) a, case when ca + ce = 0 then 0.0 else ce / (ca + ce) end i from c left join ab on ab.module = c.module) select module, round(a, 6) abstractness, round(i, 6) instability, round(abs(i + a - 1), 6) distance from k")
def coupling_abstractness(spark, d):
    """Coupling with the share of interfaces and types among what a module exports."""
    f = cur(spark, d, "path").join(modules(spark, d).withColumnRenamed("node", "id"), "id").join(texts(spark, d), "path")
    x = R.api_surface(f.select("module", "content"), "module")
    abstract = x.groupBy("module").agg(F.count_if(F.col("kind").isin("interface", "type")).alias("n"), F.count_if(F.col("kind").isin("interface", "type", "function", "class")).alias("of"))
    return G.coupling(edges(spark, d), modules(spark, d), abstract.select("module", F.try_divide(F.col("n").cast("double"), F.col("of").cast("double")).alias("abstractness"))).select("module", "abstractness", "instability", "distance")


@core.add("project_report_html", "with p as (select p.id, p.name, count(distinct f.id) files from projects p left join files f on f.project_id = p.id group by 1, 2) select '<table>' || chr(10) || '<tr><th>id</th><th>name</th><th>files</th></tr>' || chr(10) || string_agg('<tr><td>' || id || '</td><td>' || name || '</td><td>' || files || '</td></tr>', chr(10) order by id) || chr(10) || '</table>' as text from p")
def project_report_html(spark, d):
    f = table(spark, d, "files").groupBy("project_id").agg(F.count_distinct("id").alias("n"))
    p = table(spark, d, "projects").select("id", "name").join(f, F.col("id") == F.col("project_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("files"))
    return html_table(p, ["id"])
