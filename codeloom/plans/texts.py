"""Queries of the rules over source texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import basename, dirname, extension, fold, module_of
from ..functions.scalars import language_of
from ..operators import rules as R
from ..sources.tables import current_files, table, texts_once
from .registry import core


def texts(spark, d):
    return texts_once(spark, d)


_T = "tx as (select path, max(content) content from code_inputs where path is not null group by 1)"
_L = f"{_T}, ln as (select path, generate_subscripts(l, 1) line_number, unnest(l) line from (select path, string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)) l from tx where content is not null))"


@core.add("line_search", f"with {_L} select path, cast(line_number as int) line_number, trim(line, ' ') line from ln where contains(lower(line), 'todo') order by path, 2 limit 20")
def line_search(spark, d):
    return R.search_lines(texts(spark, d), "TODO", 20)


def _q(p):
    return p.replace("'", "''")


@core.add("secrets_audit", f"with {_L} " + " union all ".join(f"select path, cast(line_number as int) line_number, '{n}' rule, '{s}' severity from ln where regexp_matches(line, '{_q(p)}')" for n, s, p in R.AUDIT))
def secrets_audit(spark, d):
    return R.audit(texts(spark, d))


@core.add("documents_audit", "with ln as (select doc_id, generate_subscripts(l, 1) line_number, unnest(l) line from (select doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) l from documents)) " + " union all ".join(f"select doc_id, cast(line_number as int) line_number, '{n}' rule, '{s}' severity from ln where regexp_matches(line, '{_q(p)}')" for n, s, p in R.AUDIT))
def documents_audit(spark, d):
    return R.audit(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), key="doc_id")


#: Contracts of the queries below.
CONTRACTS = [
    {"id": "no-print", "glob": "**/*.py", "forbidden": ["print(f\"", "lambda x"], "severity": "warning"},
    {"id": "core-imports", "glob": "**/core/**/*.ts", "forbidden": ["[.][.]/storage/"], "severity": "error"},
    {"id": "licence", "glob": "**/*.rs", "required": ["licence file"], "severity": "warning"},
    {"id": "short", "glob": "**/*.go", "max_lines": 120, "severity": "warning"},
]
_CON = f"""{_L}, vi as (
 select path, 'no-print' contract, 'warning' severity, 'forbidden' kind, line_number from ln where regexp_matches(path, '(?i)^(?:.*/)?[^/]*\\.py$') and contains(line, 'print(f"')
 union all select path, 'no-print', 'warning', 'forbidden', line_number from ln where regexp_matches(path, '(?i)^(?:.*/)?[^/]*\\.py$') and contains(line, 'lambda x')
 union all select path, 'core-imports', 'error', 'forbidden', line_number from ln where regexp_matches(path, '(?i)^(?:.*/)?core/(?:.*/)?[^/]*\\.ts$') and regexp_matches(line, '(?i)[.][.]/storage/')
 union all select path, 'licence', 'warning', 'required', null from tx where regexp_matches(path, '(?i)^(?:.*/)?[^/]*\\.rs$') and content is not null and not contains(content, 'licence file')
 union all select path, 'short', 'warning', 'max_lines', null from ln where regexp_matches(path, '(?i)^(?:.*/)?[^/]*\\.go$') group by path having count(*) > 120)"""


@core.add("contracts_eval", f"with {_CON} select path, contract, severity, kind, cast(line_number as int) line_number from vi")
def contracts_eval(spark, d):
    # `print(f"` has a bracket that does not compile as a pattern, so it is plain text; `lambda x` has none.
    return R.contracts(texts(spark, d), CONTRACTS)


_COH = f"""{_CON}, vw as (select path, sum(case when severity = 'error' then 3 else 1 end) w, bool_or(severity = 'error') f from vi group by 1),
nl as (select path, count(*) n, count_if(starts_with(line, 'import ')) im from ln group by 1),
co as (select t.path, (case when n > 400 then 1 else 0 end) + (case when im > 20 then 1 else 0 end) + (case when len(list_filter(regexp_split_to_array(content, '[^A-Za-z0-9_]+'), lambda w: w = 'any')) > 5 then 1 else 0 end) + (case when len(regexp_extract_all(content, 'console\\.\\w+')) > 3 and not (contains(t.path, '/cli/commands/') or contains(t.path, '/scripts/') or contains(t.path, '/tests/')) then 1 else 0 end) + coalesce(w, 0) issues, coalesce(f, false) f from tx t join nl on nl.path = t.path left join vw on vw.path = t.path)"""


@core.add("coherence_fast", f"with {_COH} select path, cast(issues as bigint) issues, case when f or issues > 2 then 'fail' when issues = 0 then 'pass' else 'warn' end verdict, cast(round(greatest(0.3, 0.9 - issues * 0.15), 4) as double) confidence from co")
def coherence_fast(spark, d):
    t = texts(spark, d)
    return R.coherence(t, R.contracts(t, CONTRACTS))


@core.add("verdict_tally", f"with {_COH} select case when f or issues > 2 then 'fail' when issues = 0 then 'pass' else 'warn' end verdict, count(*) n from co group by 1")
def verdict_tally(spark, d):
    return coherence_fast(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


def _families(fam, kind, name):
    return " union all ".join(f"select path, '{k}' {kind}, unnest(regexp_extract_all(content, '{_q(p)}', 1)) as {name} from tx" for k, p in fam)


@core.add("feature_flags", f"with {_L} " + " union all ".join(f"select path, cast(line_number as int) line_number, '{k}' framework, '{t}' as type, unnest(regexp_extract_all(line, '{_q(p)}', 1)) as flag, contains(line, 'true') or contains(line, 'enabled') default_on from ln" for k, t, p in R.FLAGS))
def feature_flags(spark, d):
    return R.feature_flags(texts(spark, d))


@core.add("api_surface", f"with {_T} {_families(R.EXPORTS, 'kind', 'name')}")
def api_surface(spark, d):
    return R.api_surface(texts(spark, d))


@core.add("api_surface_by_kind", f"with {_T}, a as ({_families(R.EXPORTS, 'kind', 'name')}) select kind, count(*) n, count(distinct path) files from a group by 1")
def api_surface_by_kind(spark, d):
    return R.api_surface(texts(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


@core.add("unused_imports", f"with {_T}, n as (select path, content, unnest(list_distinct(regexp_extract_all(content, '(?m)^import (?:\\* as )?([A-Za-z_$][A-Za-z0-9_$]*) from', 1))) as name from tx) select path, name from n where len(list_filter(regexp_split_to_array(content, '[^A-Za-z0-9_$]+'), lambda w: w = name)) < 2")
def unused_imports(spark, d):
    return R.unused_imports(texts(spark, d))


@core.add("test_quality", f"with {_T}, x as (select path, {' + '.join(f"len(regexp_extract_all(content, '{_q(p)}'))" for p in R.TESTS)} tests, {' + '.join(f"len(regexp_extract_all(content, '{_q(p)}'))" for p in R.ASSERTIONS)} assertions from tx where content is not null and (contains(path, '.test.') or contains(path, '.spec.') or contains(path, '/tests/'))) select path, cast(tests as bigint) tests, cast(assertions as bigint) assertions, tests > 0 and assertions < tests * 1.5 weak from x")
def test_quality(spark, d):
    return R.test_quality(texts(spark, d))


@core.add("doc_titles", f"with {_T}, x as (select path, trim(regexp_extract(content, '/\\*+[ \\t]*\\n?[ \\t]*\\*?[ \\t]*([^*\\n]+)', 1), ' ') title from tx) select path, title from x where title <> ''")
def doc_titles(spark, d):
    return R.docs(texts(spark, d))


@core.add("keyword_refs", f"with {_T}, w as (select path, unnest(regexp_split_to_array(content, '[^A-Za-z0-9_]+')) as flag from tx), f as (select distinct name as flag from function_defs where id % 100 = 0) select f.flag, count(distinct w.path) texts, count(w.path) refs from f left join w on w.flag = f.flag group by 1")
def keyword_refs(spark, d):
    flags = table(spark, d, "function_defs").select(F.col("name").alias("flag"))
    return R.flag_references(flags, texts(spark, d))


@core.add("path_parts", "select distinct path, regexp_replace(replace(path, '\\', '/'), '^.*/', '') as base, regexp_replace(path, '/?[^/]*$', '') as dir, lower(regexp_extract(path, '\\.([A-Za-z0-9_+]+)$', 1)) as ext, case when contains(relative_path, '/') then split_part(relative_path, '/', 1) else '.' end as module from files where path is not null")
def path_parts(spark, d):
    f = table(spark, d, "files").where("path is not null").select("path", "relative_path").distinct()
    return f.select("path", basename(F.col("path")).alias("base"), dirname(F.col("path")).alias("dir"), extension(F.col("path")).alias("ext"), module_of(F.col("relative_path")).alias("module")).distinct()


@core.add("path_normalize", "with x as (select distinct resolved_path from imports where resolved_path is not null) select resolved_path, list_reduce(list_prepend('', list_filter(string_split(replace(resolved_path, '\\', '/'), '/'), lambda x: x <> '' and x <> '.')), lambda a, x: case when x = '..' then regexp_replace(a, '/?[^/]*$', '') when a = '' then x else a || '/' || x end) folded from x")
def path_normalize(spark, d):
    return table(spark, d, "imports").where("resolved_path is not null").select("resolved_path").distinct().withColumn("folded", fold(F.col("resolved_path")))


@core.add("language_detection", "select case lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'js' then 'javascript' when 'jsx' then 'javascript' when 'mjs' then 'javascript' when 'cjs' then 'javascript' when 'py' then 'python' when 'go' then 'go' when 'rs' then 'rust' when 'java' then 'java' when 'rb' then 'ruby' when 'cpp' then 'cpp' when 'cc' then 'cpp' when 'hpp' then 'cpp' when 'h' then 'cpp' else 'unknown' end as language, count(distinct path) files from files group by 1")
def language_detection(spark, d):
    return table(spark, d, "files").groupBy(language_of(F.col("path")).alias("language")).agg(F.count_distinct("path").alias("files"))


@core.add("incremental_changes", "with p as (select id, max(last_scanned) last from files where last_scanned < timestamp '2025-01-01' group by 1), n as (select id, max(last_scanned) now from files group by 1) select n.id, p.last is null as fresh from n left join p on p.id = n.id where p.last is null or n.now > p.last")
def incremental_changes(spark, d):
    f = table(spark, d, "files").select("id", "last_scanned")
    old = f.where("last_scanned < timestamp_ntz'2025-01-01'").groupBy("id").agg(F.max("last_scanned").alias("last"))
    now = f.groupBy("id").agg(F.max("last_scanned").alias("now"))
    return now.join(old, "id", "left").where("last is null or now > last").select("id", F.col("last").isNull().alias("fresh"))


@core.add("file_status", "with c as (select id, relative_path, project_id from (select *, row_number() over (partition by id order by last_scanned desc nulls last, hash desc nulls last, size_bytes desc nulls last) rn from files) where rn = 1) select c.id, c.relative_path, (select count(distinct i.id) from imports i where i.file_id = c.id) imports, (select count(distinct f.id) from function_defs f where f.file_id = c.id) functions, (select max(complexity) from function_defs f where f.file_id = c.id) worst from c where c.project_id = 3")
def file_status(spark, d):
    files = table(spark, d, "files")
    unnamed = current_files(files.where("id is null").withColumn("id", F.lit(0)), "relative_path").withColumn("id", F.lit(None).cast("bigint"))  # files without an id are one
    c = current_files(files, "relative_path").unionByName(unnamed)
    i = table(spark, d, "imports").groupBy(F.col("file_id").alias("id")).agg(F.count_distinct("id").alias("imports"))
    f = table(spark, d, "function_defs").groupBy(F.col("file_id").alias("id")).agg(F.count_distinct("id").alias("functions"), F.max("complexity").alias("worst"))
    return c.join(i, "id", "left").join(f, "id", "left").select("id", "relative_path", F.coalesce("imports", F.lit(0)).alias("imports"), F.coalesce("functions", F.lit(0)).alias("functions"), "worst")


@core.add("default_contracts", f"with {_L} select path, 'no-eval' contract from ln where regexp_matches(path, '(?i)\\.ts$') and regexp_matches(line, '(?i)eval\\s*\\(') union all select path, 'no-eval' from ln where regexp_matches(path, '(?i)\\.ts$') and regexp_matches(line, '(?i)new\\s+Function\\s*\\(')")
def default_contracts(spark, d):
    """The default contracts on the paths as they stand; files below none of their folders cannot break them."""
    return R.contracts(texts(spark, d), list(R.DEFAULT_CONTRACTS)).select("path", "contract")


@core.add("taint_flows")
def taint_flows(spark, d):
    return R.taint(texts(spark, d))


@core.add("feature_flag_summary", f"with {_L}, f as (" + " union all ".join(f"select path, '{k}' framework, unnest(regexp_extract_all(line, '{_q(p)}', 1)) as flag from ln" for k, t, p in R.FLAGS) + ") select framework, count(*) n, count(distinct flag) flags, count(distinct path) files from f group by 1")
def feature_flag_summary(spark, d):
    return R.feature_flags(texts(spark, d)).groupBy("framework").agg(F.count("*").alias("n"), F.count_distinct("flag").alias("flags"), F.count_distinct("path").alias("files"))
