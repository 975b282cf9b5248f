"""Queries of similarity, structure and composite reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.embedding import text_embedding
from ..operators import composite as X
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import similarity as S
from ..operators import structure as P
from ..sources.tables import table
from .graphs import _RES, edges
from .records import patterns, sessions_latest
from .registry import core
from .reports import CUR, cur
from .texts import texts

_DOT = "list_inner_product({0}::double[], {1}::double[])"
_COS = f"round({_DOT.format('a.v', 'b.v')} / (sqrt({_DOT.format('a.v', 'a.v')}) * sqrt({_DOT.format('b.v', 'b.v')})), 6)"


@core.add("cosine_topk", f"with e as (select vec_id id, embedding v from embeddings), s as (select a.id, b.id neighbour, {_COS} score from e a join e b on a.id <> b.id where a.id % 100 = 0) select * exclude (rn) from (select *, row_number() over (partition by id order by score desc, neighbour) rn from s where score >= 0.2) where rn <= 10")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return S.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10, 0.2)


_FE = f"{CUR}, e as (select id, embedding v from (select id, embedding, row_number() over (partition by id order by last_scanned desc nulls last, hash desc nulls last, size_bytes desc nulls last) rn from files) where rn = 1 and embedding is not null and len(embedding) > 0 and list_inner_product(embedding, embedding) > 0)"


@core.add("redundancy_top5", f"with {_FE}, s as (select a.id, b.id neighbour, {_COS} score from e a join e b on a.id <> b.id and len(a.v) = len(b.v) where a.id % 100 = 0) select * exclude (rn) from (select *, row_number() over (partition by id order by score desc, neighbour) rn from s where score > 0.95) where rn <= 5")
def redundancy_top5(spark, d):
    f = cur(spark, d, "embedding")
    return S.nearest(f.where("id % 100 = 0"), f, "id", "embedding", 5, 0.95, strict=True)


@core.add("hash_embedding")
def hash_embedding(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text_embedding(F.col("text")).alias("embedding"))


@core.add("structure_nodes")
def structure_nodes(spark, d):
    return P.parse(texts(spark, d)).select("path", "kind", "name", "start_line", "end_line", "complexity")


@core.add("structural_search")
def structural_search(spark, d):
    return P.search(P.parse(texts(spark, d)), kind="function", name="^(?:resolve|replay)", contains="return").select("path", "name", "start_line")


_PAT = f"""{CUR}, f as (select distinct id, file_id, name from function_defs), i as (select distinct id, file_id, source from imports),
ia as (select file_id, bool_or(starts_with(source, '.')) rel, bool_or(starts_with(source, '@/') or starts_with(source, '#')) ab, bool_or(starts_with(source, 'node:')) node, bool_or(not starts_with(source, '.') and not starts_with(source, '@/') and not starts_with(source, '#') and not starts_with(source, 'node:')) ext, count(*) n from i group by 1),
fa as (select file_id, count(*) n from f group by 1),
j as (select c.id file_id, floor(coalesce(size_bytes, 0) / 20 + 0.5) lines, coalesce(rel, false) rel, coalesce(ab, false) ab, coalesce(node, false) node, coalesce(ext, false) ext, coalesce(ia.n, 0) im, coalesce(fa.n, 0) fu from cur c left join ia on ia.file_id = c.id left join fa on fa.file_id = c.id),
p as (select file_id, 'imports' category, cast(case when node then greatest(case when ab and not rel then 0.95 when rel and not ab and not ext then 0.9 else 0.7 end, 0.9) when ab and not rel then 0.95 when rel and not ab and not ext then 0.9 else 0.7 end as double) confidence from j
 union all select file_id, 'structure', cast(greatest(case when lines > 50 and lines < 300 then 0.8 else 0.6 end, case when fu / greatest(lines, 1) > 0.05 and fu / greatest(lines, 1) < 0.3 then 0.8 else 0 end, case when im > 0 and im < 20 then 0.85 else 0 end) as double) from j
 union all select file_id, 'structure', cast(case when fu < 20 then 0.9 when fu < 50 then 0.7 else 0.5 end as double) from j
 union all select file_id, 'naming', cast(case when regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') or regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') then 0.9 when regexp_matches(name, '^[a-z][a-z0-9_]*$') or regexp_matches(name, '^[A-Z][A-Z0-9_]*$') then 0.85 else 0.5 end as double) from f)"""


@core.add("pattern_extraction", f"with {_PAT} select category, confidence, count(*) n from p group by 1, 2")
def pattern_extraction(spark, d):
    f = cur(spark, d, "size_bytes").withColumn("lines", F.floor(F.coalesce("size_bytes", F.lit(0)) / 20 + 0.5))
    fn = table(spark, d, "function_defs").select("id", "file_id", "name").distinct()
    im = table(spark, d, "imports").select("id", "file_id", "source").distinct()
    return X.extract_patterns(f, fn, im).groupBy("category", "confidence").agg(F.count("*").alias("n"))


_ARCH = f"""{CUR}, u as (select file_id, count(distinct id) n from imports where not resolved and starts_with(source, '.') group by 1), k as (select file_id, count_if(complexity > 10) c from (select distinct * exclude (embedding) from function_defs) group by 1)"""


@core.add("architecture_check", f"with {_ARCH} select c.id, array_to_string(list_filter([case when coalesce(u.n, 0) > 0 then 'unresolved-imports' end, case when coalesce(cognitive_load, 0) > 0.7 then 'high-load' end, case when coalesce(k.c, 0) > 0 then 'complex-functions' end], lambda x: x is not null), ',') issues, array_to_string(list_filter([case when coalesce(cognitive_load, 0) > 0.4 and coalesce(cognitive_load, 0) <= 0.7 then 'load' end, case when coalesce(size_bytes, 0) > 50000 then 'size' end, case when not coalesce(agent_touched, false) then 'untouched' end], lambda x: x is not null), ',') warnings, coalesce(u.n, 0) = 0 and coalesce(cognitive_load, 0) <= 0.7 and coalesce(k.c, 0) = 0 compliant from cur c left join u on u.file_id = c.id left join k on k.file_id = c.id")
def architecture_check(spark, d):
    u = table(spark, d, "imports").where(~F.col("resolved") & F.col("source").startswith(".")).groupBy("file_id").agg(F.count_distinct("id").alias("n"))
    fn = table(spark, d, "function_defs").drop("embedding").distinct()
    return X.architecture_check(cur(spark, d), u, fn)


@core.add("pr_preview", f"with {_RES}, {CUR}, dep as (select dst, count(*) n from ed where src <> dst group by 1), g as (select c.project_id, count(*) changed, round(max(coalesce(cognitive_load, 0.0)), 6) worst_load, cast(coalesce(sum(n), 0) as bigint) affected from cur c left join dep on dep.dst = c.id where c.last_scanned >= timestamp '2025-06-01' group by 1) select *, case when worst_load > 0.5 then 'high' when worst_load > 0.2 then 'medium' else 'low' end risk, greatest(10, changed * 3 + 2) as minutes from g")
def pr_preview(spark, d):
    f = cur(spark, d)
    changed = f.where("last_scanned >= timestamp_ntz'2025-06-01'").select("id")
    return X.pr_preview(f, changed, G.dependents(edges(spark, d)))


@core.add("skill_gaps", f"with {CUR}, lv as (select agent_touched_by agent, language skill, least(count(*) / 20.0, 1.0) lev from cur where agent_touched and agent_touched_by is not null and language in ('typescript', 'python', 'go') group by 1, 2), sk as (select unnest(['typescript', 'python', 'go']) skill, unnest([0.9, 0.7, 0.5]) importance), ag as (select distinct agent_touched_by agent from cur where agent_touched and agent_touched_by is not null), g as (select a.agent, s.skill, s.importance, round(cast(s.importance as double) - coalesce(cast(lv.lev as double), 0.0), 6) gap from ag a cross join sk s left join lv on lv.agent = a.agent and lv.skill = s.skill) select agent, skill, gap, case when gap > 0.5 and importance > 0.8 then 'critical' when gap > 0.4 then 'high' when gap > 0.25 then 'medium' else 'low' end priority, cast(ceil(gap * 20) as bigint) as hours from g where gap >= 0.3")
def skill_gaps(spark, d):
    f = cur(spark, d).where("agent_touched and agent_touched_by is not null").withColumnRenamed("agent_touched_by", "agent")
    levels = f.where("language in ('typescript', 'python', 'go')").groupBy("agent", F.col("language").alias("skill")).agg(F.least(F.count("*") / 20.0, F.lit(1.0)).alias("level"))
    skills = spark.createDataFrame([("typescript", 0.9), ("python", 0.7), ("go", 0.5)], "skill string, importance double")
    return X.skill_gaps(levels, skills, f)


_GEN = f"""{_PAT.replace('p as (', 'pq as (')}, nm as (select md5(name) h, max(case when regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') or regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') then 0.9 when regexp_matches(name, '^[a-z][a-z0-9_]*$') or regexp_matches(name, '^[A-Z][A-Z0-9_]*$') then 0.85 else 0.5 end) c, count(*) u from (select distinct id, name from function_defs) group by 1),
gp as (select coalesce(sum(c * greatest(u, 1)) / sum(greatest(u, 1)), 1.0) weighted, coalesce(sum(c) / greatest(count(*), 1), 1.0) average from nm),
gs as (select (select count(*) from orders where o_orderstatus <> 'F' and o_totalprice > 450000) high, (select count(*) from mu) cycles, (select count_if(resolved) / count(*) from (select distinct id, resolved from imports)) rate, (select count(distinct user_id) from events) sessions),
sc as (select round(greatest(0.0, least(1.0, 0.7 * weighted + 0.3 * average - least(high * 0.02, 0.3) - least(cycles * 0.05, 0.2) + 0.05 * rate + 0.05 * least(sessions / 10, 1.0))), 4) score, high, cycles, round(rate, 4) import_rate, sessions from gp, gs)"""
_GENOME = f"with {_RES}, mu as (select x.src from ed x join ed y on x.src = y.dst and x.dst = y.src where x.src < x.dst), {_GEN}"
_LABEL = "case when score >= 0.9 then 'Excellent' when score >= 0.75 then 'Good' when score >= 0.6 then 'Fair' else 'Poor' end"


def genome(spark, d):
    u = F.greatest("usage_count", F.lit(1))
    p = patterns(spark, d).agg(F.coalesce(F.try_divide(F.sum(F.col("confidence") * u), F.sum(u)), F.lit(1.0)).alias("weighted"), F.coalesce(F.sum("confidence") / F.greatest(F.count("*"), F.lit(1)), F.lit(1.0)).alias("average"))
    high = table(spark, d, "orders").where("o_orderstatus <> 'F' and o_totalprice > 450000").agg(F.count("*").alias("n"))
    cycles = G.mutual(edges(spark, d)).agg(F.count("*").alias("n"))
    rate = table(spark, d, "imports").select("id", "resolved").distinct().agg((F.count_if("resolved") / F.count("*")).alias("rate"))
    n = sessions_latest(spark, d).agg(F.count("*").alias("n"))
    return M.genome(p, high, cycles, rate, n)


@core.add("genome_score", f"{_GENOME} select score, {_LABEL} as label, high, cycles, import_rate, sessions from sc")
def genome_score(spark, d):
    return genome(spark, d)


@core.add("health_status", f"{_GENOME}, r as (select count(*) total_files, round(sum(coalesce(cognitive_load, 0)) / greatest(count(*), 1), 6) average_load, round(count_if(agent_touched) / greatest(count(*), 1), 6) agent_coverage from cur) select case when high > 0 then 'unhealthy' when agent_coverage = 0 or average_load >= 0.5 or score <= 0.7 then 'degraded' else 'healthy' end status, total_files, agent_coverage, average_load, score, high from r, sc")
def health_status(spark, d):
    return M.health(cur(spark, d), genome(spark, d))
