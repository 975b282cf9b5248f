import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions.scalars import layer_glob_regex
from codeloom.operators import advice as A
from codeloom.operators import debt as D
from codeloom.operators import graph as G
from codeloom.operators import metrics as M
from codeloom.operators import rules as R
from codeloom.operators import store as S
from codeloom.operators import textops as T
from codeloom.sources.tables import texts_once

FILES = "id bigint, project_id bigint, path string, relative_path string, agent_touched boolean, agent_touched_by string, agent_touched_at timestamp_ntz"
AT = [dt.datetime(2025, 1, d) for d in range(1, 10)]


def test_projects(spark, rows):
    p = spark.createDataFrame([(1, "default"), (3, "x")], "id bigint, name string")
    f = spark.createDataFrame([(1, 3), (2, 1), (3, None)], "id bigint, project_id bigint")
    a, b = S.delete_project(p, f, 3)
    assert rows(a) == [(1, "default")] and rows(b.select("id")) == [(2,), (3,)]
    with pytest.raises(ValueError):
        S.delete_project(p, f, 1)


def test_touches_by_either_path(spark, rows):
    f = spark.createDataFrame([(1, 1, "/r/a.ts", "a.ts", False, None, None), (2, 1, "/r/b.ts", "b.ts", None, None, None), (3, 2, "/q/a.ts", "a.ts", True, "old", AT[0])], FILES)
    t = spark.createDataFrame([(1, "/r/a.ts", "x", AT[1], 1), (1, "a.ts", "y", AT[2], 2), (1, "a.ts", "z", AT[2], 1), (9, "a.ts", "w", AT[3], 1), (1, "none", "w", AT[3], 1)], "project_id bigint, path string, agent string, at timestamp_ntz, seq int")
    got = rows(S.mark_touched(f, t).select("id", "agent_touched", "agent_touched_by", "agent_touched_at"))
    assert got == [(1, True, "y", AT[2]), (2, None, None, None), (3, True, "old", AT[0])]
    assert rows(S.mark_touched(f, t.limit(0))) == rows(f)


def test_lookup_prefers_the_exact_path(spark, rows):
    f = spark.createDataFrame([(1, "a.ts", "x/a.ts"), (2, "/r/a.ts", "a.ts"), (3, "/s/b.ts", "b.ts"), (4, "/t/b.ts", "b.ts"), (5, None, None)], "id bigint, path string, relative_path string")
    r = spark.createDataFrame([(1, "a.ts"), (2, "b.ts"), (3, "c.ts"), (4, None)], "n int, path string")
    assert rows(S.lookup_paths(r, f).select("n", "file_id")) == [(1, 1), (2, 3), (3, None), (4, None)]


def test_rows_are_inserted_once(spark, rows):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "z"), (3, "d"), (3, "c")], "k int, v string")
    once = S.insert_new(t, new, ["k"])
    assert rows(once) == [(1, "a"), (2, "b"), (3, "c")] == rows(S.insert_new(once, new, ["k"]))
    assert rows(S.truncate(t)) == []


def test_stubs(spark, rows):
    f = spark.createDataFrame([(5, "a"), (7, "a"), (9, None)], "id bigint, name string")
    t = spark.createDataFrame([("a", "b", "w", 2, False, 1), ("a", "b", "w", None, True, 2), ("b", "a", None, 1, None, 3)], "from_name string, to_name string, workload_id string, call_count bigint, static_missed boolean, seq int")
    e, stubs = S.ingest_by_name(t, f)
    assert rows(e.select("from_name", "from_id", "to_stub", "call_count", "static_missed").where("from_name = 'a'")) == [("a", 5, True, 3, True)]
    assert rows(stubs.select("name")) == [("b",)]
    assert rows(stubs.select("id")) == rows(e.where("to_stub").select("to_id"))


def components(edges):
    out = {}
    nodes = {n for e in edges for n in e}
    to = {n: {b for a, b in edges if a == n} for n in nodes}

    def reach(n):
        seen, todo = set(), list(to[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += to[x]
        return seen

    r = {n: reach(n) for n in nodes}
    for n in nodes:
        if n in r[n]:
            same = {m for m in r[n] if n in r[m]}
            out[n] = (min(same), len(same))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rings(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(34)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 103), (7, 7)]
    e = spark.createDataFrame([*edges, (None, 1), (1, None)], "src bigint, dst bigint")
    assert {r.node: (r.ring, r.size) for r in G.rings(e).collect()} == components(edges)
    assert G.rings(e.limit(0)).count() == 0


def test_paths_are_the_smallest_of_the_shortest(spark):
    e = spark.createDataFrame([(1, 3), (1, 2), (2, 4), (3, 4), (4, 5), (5, 1), (1, 1), (None, 2)], "src bigint, dst bigint")
    w = {r.node: (r.depth, r.path) for r in G.walk_paths(e, spark.createDataFrame([(1,), (None,)], "seed bigint"), 3).collect()}
    assert w == {2: (1, [1, 2]), 3: (1, [1, 3]), 4: (2, [1, 2, 4]), 5: (3, [1, 2, 4, 5])}


def test_modules_below_modules(spark, rows):
    m = spark.createDataFrame([("a",), ("a/b",), ("a/bc",), ("a/b/c/d",), ("",), (None,)], "module string")
    assert rows(G.nested_modules(m)) == [("a/b", "a"), ("a/b/c/d", "a"), ("a/b/c/d", "a/b"), ("a/bc", "a")]


def test_suggestions(spark, rows):
    f = spark.createDataFrame([(1, 0.9, True), (2, 0.1, False)], "id bigint, cognitive_load double, agent_touched boolean")
    fn = [(1, 1, "f", "f( a)", 21), (2, 1, "g", "f(\na)", 11), (3, 2, "f", "f(b)", None), (4, 3, "f", "f(b)", 1), (4, 3, "f", "f(b)", 1), (5, 3, "f", "f( a)", 1)]
    im = [(n, 1, "../x", None) for n in range(11)]
    got = A.suggestions(f, spark.createDataFrame(fn, "id bigint, file_id bigint, name string, signature string, complexity int"), spark.createDataFrame(im, "id bigint, file_id bigint, source string, resolved_id bigint"), spark.createDataFrame([(2, "Big", 16)], "file_id bigint, name string, methods int"))
    want = [
        (1, "architecture", "low", None, 11.0), (1, "architecture", "medium", None, 11.0), (1, "complexity", "high", "f", 21.0), (1, "complexity", "high", None, 0.9), (1, "complexity", "medium", "g", 11.0),
        (1, "duplication", "low", "f", 2.0), (1, "duplication", "medium", "f( a)", 1.0), (2, "consistency", "low", None, None), (2, "duplication", "low", "f", 2.0), (2, "performance", "medium", "Big", 16.0),
        (3, "duplication", "low", "f", 1.0), (3, "duplication", "low", "f", 1.0),
    ]
    assert rows(got.drop("rank")) == sorted(want, key=repr)
    assert {r.rank for r in got.where("priority = 'low'").collect()} == {2}


def test_page_with_more(spark):
    x = spark.createDataFrame([(i, "t", "high", False, AT[i % 9]) for i in range(7)], "id bigint, type string, severity string, resolved boolean, detected_at timestamp_ntz")
    assert [r.has_more for r in D.page_with_more(x, 3).collect()] == [True] * 3
    assert [r.has_more for r in D.page_with_more(x, 3, 4).collect()] == [False] * 3
    assert D.page_with_more(x, 0).count() == 7


def test_budget_takes_the_large_first_for_coverage(spark, rows):
    s = spark.createDataFrame([(1, 1, 0.9, 0.1, 60), (2, 1, 0.1, 0.9, 50), (3, 1, 0.5, 0.5, 40)], "id bigint, project_id bigint, relevance double, priority double, tokens bigint")
    got = {k: rows(M.budget_report(s, 100, k).select("selected", "used", "recommendations"))[0] for k in M.STRATEGIES}
    assert got == {"relevance": (2, 100, "exhausted,large-files"), "diversity": (2, 90, "large-files"), "coverage": (2, 100, "exhausted,large-files"), "hybrid": (2, 100, "exhausted,large-files")}


def test_layer_globs_keep_their_behaviour():
    import re

    assert re.match(layer_glob_regex("**/lib/**"), "src/lib/x") and not re.match(layer_glob_regex("**/lib/**"), "a/b/lib/x")
    assert re.match(layer_glob_regex("*.ts"), "axts") and not re.match(layer_glob_regex("*.ts"), "a/b.ts")


def test_contracts_in_one_pass(spark, rows):
    t = spark.createDataFrame([("a/x.ts", "eval(1)\nok\nimport z from 'cli/q'\n"), ("b.py", "fine"), ("c.ts", None), (None, "eval(")], "path string, content string")
    c = [{"id": "e", "glob": "**/*.ts", "forbidden": [r"eval\s*\("], "forbidden_imports": ["cli/"], "max_lines": 3}, {"id": "r", "glob": "**/*.py", "required": ["must"], "severity": "error"}]
    assert rows(R.contracts(t, c)) == [("a/x.ts", "e", "warning", "forbidden", 1), ("a/x.ts", "e", "warning", "forbidden_import", 3), ("a/x.ts", "e", "warning", "max_lines", None), ("b.py", "r", "error", "required", None)]


def test_private_urls(spark):
    urls = ["http://localhost:1/x", "https://10.0.0.1/", "https://172.20.1.1", "https://172.33.1.1", "https://192.168.1.9/a", "https://example.org", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(T.private_url(F.col("u")).alias("p")).collect()
    assert [r.p for r in got] == [True, True, True, False, True, False, False]


def test_texts_come_once(spark, rows, tmp_path):
    spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("b", "2"), ("b", "2"), ("c", None), (None, "x")], "path string, content string").repartition(3).write.parquet(str(tmp_path / "code_inputs.parquet"))
    assert rows(texts_once(spark, str(tmp_path))) == [("a", "1"), ("b", "2"), ("c", None)]


def test_kinds_tags_and_flags(spark, rows):
    t = spark.createDataFrame([("x.test.ts", "import 'jest'; e2e"), ("y/tests/a.ts", "plain"), ("feature.ts", "/** T\n * @since 1.2\n * @deprecated */\nconst f = { dark: { a: 1, enabled: true }, light: {enabled:false} }"), ("z.ts", None)], "path string, content string")
    assert rows(R.test_kinds(t)) == [("x.test.ts", "jest", "e2e"), ("y/tests/a.ts", "vitest", "unit")]
    assert rows(R.doc_tags(t).drop("doc_length")) == [("feature.ts", "1.2", True)]
    assert rows(R.config_flags(t)) == [("feature.ts", "dark", True), ("feature.ts", "light", False)]


def test_declarations_by_lexing():
    from codeloom.operators import structure as P

    ts = "import a from 'b';\n// function no() {}\nexport async function f({ x }: P, y = {}) {\n  // if while &&\n  const s = 'if (a && b)';\n  if (x && y) { return x ? 1 : 2; }\n}\n\nexport class K {\n  m() { if (a) {} }\n}\nconst z = `function q() {}`;\n"
    assert [(k, n, a, b, c) for k, n, a, b, _, _, c in P.nodes_of("a.ts", ts)] == [("import", "b", 1, 1, 1), ("function", "f", 3, 7, 4), ("class", "K", 9, 11, 1)]
    java = "package a;\nimport b.C;\npublic class A<T> {\n\tpublic static <T> List<Map<T, int[]>> go(final int a, T b) throws E {\n    for (;;) { if (a > 1 || b) return null; }\n  }\n private A(int x) {\n  }\n  void h() { return new B(); }\n}\n"
    assert [(k, n, c) for k, n, *_, c in P.nodes_of("A.java", java)] == [("import", "b.C", 1), ("class", "A", 1), ("function", "go", 4), ("function", "A", 1), ("function", "h", 1)]
    cs = "using System.Text;\npublic sealed class A {\n  public async Task<int> Go(int a) {\n    return a > 1 ? 2 : 3;\n  }\n}\n"
    assert [(k, n, c) for k, n, *_, c in P.nodes_of("a.cs", cs)] == [("import", "System.Text", 1), ("class", "A", 1), ("function", "Go", 2)]
    rb = "# def no\nclass A\n  def f\n    x = { a: 1 }\n    y if x\n  end\nend\n"
    assert [(k, n, b) for k, n, _, b, *_ in P.nodes_of("a.rb", rb)] == [("class", "A", 2), ("function", "f", 7)]


def test_of_several_texts_of_a_path_the_greatest_is_kept(spark, rows, tmp_path):
    pairs = [("a", None), ("a", "new flag"), ("b", "x"), ("b", "y flag"), ("b", "y flag"), ("c", None), ("c", None), (None, "flag")]
    spark.createDataFrame(pairs, "path string, content string").coalesce(1).write.parquet(f"{tmp_path}/code_inputs.parquet")
    assert rows(texts_once(spark, str(tmp_path))) == [("a", "new flag"), ("b", "y flag"), ("c", None)]


def test_status_of_files_without_an_id(spark, rows, tmp_path):
    from codeloom.plans.texts import file_status

    files = [(None, "old.ts", "2024-01-01", "h", 1), (None, "new.ts", "2024-02-01", "h", 1), (0, "zero.ts", None, "h", 1), (0, "late.ts", "2024-01-01", "g", 1)]
    spark.createDataFrame(files, "id bigint, relative_path string, at string, hash string, size_bytes bigint").withColumn("last_scanned", F.col("at").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([(1, 0), (1, 0), (2, None)], "id bigint, file_id bigint").write.parquet(f"{tmp_path}/imports.parquet")
    spark.createDataFrame([(1, 0, 7), (2, None, 9)], "id bigint, file_id bigint, complexity int").write.parquet(f"{tmp_path}/function_defs.parquet")
    assert rows(file_status(spark, str(tmp_path))) == [(0, "late.ts", 1, 1, 7), (None, "new.ts", 0, 0, None)]
