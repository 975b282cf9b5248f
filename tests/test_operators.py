import datetime as dt

from pyspark.sql import functions as F

from codeloom.operators import calls as C
from codeloom.operators import composite as X
from codeloom.operators import debt as D
from codeloom.operators import flows as L
from codeloom.operators import graph as G
from codeloom.operators import metrics as M
from codeloom.operators import rules as R
from codeloom.operators import similarity as S
from codeloom.operators import structure as P
from codeloom.operators import upsert as U

T = [dt.datetime(2025, 1, d) for d in range(1, 29)]


def edges(spark, e):
    return spark.createDataFrame(e, "src bigint, dst bigint")


def test_walk_takes_shortest_depth_and_stops(spark, rows):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 1), (3, 4), (None, 5), (4, None)])
    assert rows(G.walk(e, spark.createDataFrame([(1,), (9,), (None,)], "seed bigint"), 10)) == [(1, 2, 1), (1, 3, 1), (1, 4, 2)]
    assert rows(G.walk(e.where("false"), spark.createDataFrame([(1,)], "seed bigint"), 3)) == []


def test_cycles(spark, rows):
    e = edges(spark, [(1, 1), (2, 3), (3, 2), (4, 5), (5, 6), (6, 4), (6, 5), (7, 8)])
    assert rows(G.short_cycles(e, 3).select(F.array_join(F.col("cycle").cast("array<string>"), "-"))) == [("1",), ("2-3",), ("4-5-6",), ("5-6",)]
    assert rows(G.mutual(e)) == [(2, 3), (5, 6)]


def test_impact_and_coupling(spark, rows):
    e = edges(spark, [(i, 1) for i in range(2, 9)] + [(9, 2), (10, 9)])
    assert rows(G.impact(e, spark.createDataFrame([(1,)], "seed bigint"))) == [(1, 7, 1, 1, 9, "high")]
    m = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (99, "lonely")], "node bigint, module string")
    assert rows(G.coupling(e, m)) == [("a", 1, 0, 0.0, 1.0, "leaf"), ("b", 0, 1, 1.0, 0.0, "plain"), ("lonely", 0, 0, 0.0, 1.0, "plain")]


def test_layers(spark, rows):
    p = spark.createDataFrame([(1, "x/cli/a"), (2, "x/storage/b"), (3, "else")], "node bigint, path string")
    a = G.first_layer(p, [("ui", 0, ["/cli/"]), ("mid", 1, ["/mid/"]), ("db", 2, ["/storage/", "/cli/"])])
    assert rows(a.select("node", "layer")) == [(1, "ui"), (2, "db"), (3, None)]
    assert rows(G.layer_violations(edges(spark, [(1, 2), (2, 1), (1, 3)]), a)) == [(1, "ui", 1, "db", "error")]


def test_upserts(spark, rows):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, seq int")
    new = spark.createDataFrame([(1, "c", 3), (1, "d", 4), (3, None, 5)], "k int, v string, seq int")
    out = U.upsert(old, new, ["k"], ["seq"])
    assert rows(out) == [(1, "d", 4), (2, "b", 2), (3, None, 5)]
    assert rows(U.upsert(out, new, ["k"], ["seq"])) == rows(out)  # the same rows again change nothing
    e = spark.createDataFrame([(1, None), (2, T[5]), (3, T[4]), (4, T[6])], "id int, until timestamp_ntz")
    assert rows(U.expire(e, "until", F.lit(T[5]).cast("timestamp_ntz")).select("id")) == [(1,), (4,)]
    assert rows(U.delete(old, F.col("v") == F.lit(None))) == rows(old)


def test_calls(spark, rows):
    c = spark.createDataFrame([(1, 1, 2, "w", 3, True, T[1]), (2, 1, 2, "w", None, False, T[2]), (3, 1, 2, "w", 0, None, T[0]), (4, 1, 2, None, 5, False, T[1])], "id bigint, from_function_id bigint, to_function_id bigint, workload_id string, call_count bigint, static_missed boolean, detected_at timestamp_ntz")
    assert rows(C.normalize(c)) == [(1, 2, "w", 5, True), (1, 2, None, 5, False)]
    assert rows(C.ingest(c)) == [(1, 2, "w", 4, False, 3), (1, 2, None, 5, False, 1)]
    f = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id bigint, name string")
    assert rows(C.by_name(c, f)) == [("a", "b", 9)]


def test_flows(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "source string, target string")
    assert rows(L.resource_flows(e).where("resource = 'b'")) == [("b", "in", "a", 2), ("b", "out", "c", 1)]
    assert rows(L.data_flows(e, spark.createDataFrame([(7, "a"), (5, "a"), (9, None)], "id bigint, name string")).select("source", "source_function_id").distinct()) == [("a", 5), ("b", None)]


def test_debt(spark, rows):
    d = spark.createDataFrame([(1, "x", "high", False, T[3], None), (2, "x", "low", False, T[0], None), (3, "y", "low", True, T[0], T[1]), (4, "y", None, None, T[9], None)], "id bigint, type string, severity string, resolved boolean, detected_at timestamp_ntz, resolved_at timestamp_ntz")
    b = {(r.dimension, r.value): r.n for r in D.breakdown(d, ["x", "y", "z"]).collect()}
    assert b == {("total", "all"): 3, ("severity", "high"): 1, ("severity", "medium"): 0, ("severity", "low"): 1, ("type", "x"): 2, ("type", "y"): 1, ("type", "z"): 0}
    assert [r.id for r in D.page(d, 1, 1).collect()] == [1] and D.page(d, 0).count() == 3
    assert [r.id for r in D.prioritized(d).collect()] == [1, 2, 4]
    assert rows(D.cleanup(d, F.lit(T[20]).cast("timestamp_ntz"), 10).select("id")) == [(1,), (4,)]
    assert rows(D.resolve(d, spark.createDataFrame([(1,)], "id bigint"), F.lit(T[5]).cast("timestamp_ntz")).where("resolved").select("id")) == [(1,), (3,)]


def test_rules(spark, rows):
    t = spark.createDataFrame([("a.ts", "x\r\nconst token = 'abcdefgh'\n\neval (1)"), ("b.ts", None), ("c.ts", "")], "path string, content string")
    assert rows(R.audit(t)) == [("a.ts", 2, "secret", "high"), ("a.ts", 4, "eval", "high")]
    v = R.contracts(t, [{"id": "k", "glob": "*.ts", "forbidden": [r"eval\s*\("], "required": ["licence"], "max_lines": 3, "severity": "error"}])
    assert rows(v) == [("a.ts", "k", "error", "forbidden", 4), ("a.ts", "k", "error", "max_lines", None), ("a.ts", "k", "error", "required", None), ("c.ts", "k", "error", "required", None)]
    assert rows(R.coherence(t, v)) == [("a.ts", 9, "fail", 0.3), ("c.ts", 3, "fail", 0.45)]
    assert rows(R.search_lines(t, "TOKEN")) == [("a.ts", 2, "const token = 'abcdefgh'")]


def test_flags_api_taint(spark, rows):
    code = "export async function go(a) {}\nexport class B {}\nif (isEnabled('f1')) { x = process.env.NEW_FLAG; } // true\nconst d = fs.readFileSync('p');\nexec(d, 1);\nspawn(e);"
    t = spark.createDataFrame([("a.ts", code)], "path string, content string")
    assert rows(R.feature_flags(t)) == [("a.ts", 3, "custom", "env", "NEW_FLAG", True), ("a.ts", 3, "unleash", "function", "f1", True)]
    assert rows(R.api_surface(t)) == [("a.ts", "class", "B"), ("a.ts", "function", "go")]
    assert rows(R.taint(t)) == [("a.ts", "d", "fs.readFileSync", "FILE", "exec", "SOCKET")]
    a = spark.createDataFrame([("f", "x"), ("g", "y"), ("h", None)], "name string, sig string")
    b = spark.createDataFrame([("f", "z"), ("k", "y"), ("h", None)], "name string, sig string")
    assert rows(R.api_diff(a, b, ["name"], "sig")) == [("f", "changed", True), ("g", "removed", True), ("k", "added", False)]


def test_metrics_on_empty_and_null(spark, rows):
    schema = "id bigint, project_id bigint, relative_path string, language string, size_bytes bigint, cognitive_load double, agent_touched boolean, agent_touched_by string"
    none = spark.createDataFrame([], schema)
    assert rows(M.scale_report(none)) == [(0, 0, 0, 0.0, 0.0)]
    f = spark.createDataFrame([(1, 1, "a/trace.ts", None, None, None, None, None), (2, 1, "b.ts", "go", 50, 0.9, True, "x")], schema)
    assert rows(M.scale_report(f)) == [(2, 50, 3, 0.45, 0.5)]
    assert rows(M.language_breakdown(f)) == [("go", 1, 50), ("unknown", 1, 0)]
    assert rows(M.module_rollup(f).select("module", "files")) == [(".", 1), ("a", 1)]


def test_budget_skips_what_does_not_fit(spark, rows):
    s = spark.createDataFrame([(1, 1, 0.9, 60), (2, 1, 0.8, 50), (3, 1, 0.7, 40), (4, 2, 0.1, 500)], "id bigint, project_id bigint, priority double, tokens bigint")
    assert rows(M.context_budget(s, 100)) == [(1, 100, 1), (1, 100, 3)]


def test_budget_considers_every_file(spark, rows):
    # Beyond rank 1000: a file that still fits and one of no tokens; before them what never fits, or no longer does.
    f = [(i, 1, 1.0, 60 if i % 2 else 500) for i in range(1, 1501)] + [(1501, 1, 0.5, 30), (1502, 1, 0.4, 0), (1503, 1, 0.3, 11), (1504, 1, 0.2, 10), (2000, 2, 0.1, 0), (2001, 2, 0.2, None), (3000, None, 0.1, 0), (3001, None, 0.2, 7)]
    s = spark.createDataFrame(f, "id bigint, project_id bigint, priority double, tokens bigint")
    assert rows(M.context_budget(s, 100)) == sorted([(1, 100, 1), (1, 100, 1501), (1, 100, 1502), (1, 100, 1504), (2, 0, 2000), (None, 7, 3000), (None, 7, 3001)], key=repr)


def test_budget_equals_fold_over_all(spark, rows):
    import random

    r = random.Random(5)
    f = [(i, i % 3, r.randrange(50) / 50, r.choice([0, 1, 2, 3, 5, 8, 20, 60, 90, 300])) for i in range(4000)]
    want = []
    for p in range(3):
        used, ids = 0, []
        for i, _, _, t in sorted((x for x in f if x[1] == p), key=lambda x: (-x[2], x[0])):
            if used + t <= 250:
                used += t
                ids.append(i)
        want += [(p, used, i) for i in ids]
    s = spark.createDataFrame(f, "id bigint, project_id bigint, priority double, tokens bigint")
    assert rows(M.context_budget(s, 250)) == sorted(want, key=repr)


def test_nearest(spark, rows):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [1.0, 0.1])], "id bigint, e array<double>")
    assert rows(S.nearest(v, v, "id", "e", 1, 0.7)) == [(1, 2, 1.0), (2, 1, 1.0), (7, 1, 0.995037)]
    assert rows(S.nearest(v.where("false"), v, "id", "e")) == []


def test_structure(spark, rows):
    t = spark.createDataFrame([("a.ts", "import { x } from './y';\nexport async function go(a) {\n  if (a && x) return 1;\n}\nexport class K {}\n"), ("b.py", "import os\ndef f(x):\n    return x if x else 0\n"), ("c.xyz", "def f"), ("d.py", "def ("), ("e.ts", None)], "path string, content string")
    n = P.parse(t)
    assert rows(n.select("path", "kind", "name", "start_line", "complexity")) == [("a.ts", "class", "K", 5, 1), ("a.ts", "function", "go", 2, 3), ("a.ts", "import", "./y", 1, 1), ("b.py", "function", "f", 2, 2), ("b.py", "import", "os", 1, 1)]
    m = P.search(n, kind="function", modifier="AsyncKeyword")
    assert [r.name for r in m.collect()] == ["go"]
    out = P.replace(t, m, "// gone").collect()
    assert [(r.path, r.replaced, r.content.split("\n")[1]) for r in out] == [("a.ts", 1, "// gone")]


def test_patterns(spark, rows):
    f = spark.createDataFrame([(1, 100), (2, 10)], "id bigint, lines bigint")
    fn = spark.createDataFrame([(1, "fooBar"), (1, "x-y")], "file_id bigint, name string")
    im = spark.createDataFrame([(1, "./a"), (2, "node:fs")], "file_id bigint, source string")
    assert rows(X.extract_patterns(f, fn, im)) == [(1, "imports", "import_style", 0.9), (1, "naming", "fooBar", 0.9), (1, "naming", "x-y", 0.5), (1, "structure", "complexity", 0.9), (1, "structure", "structure_profile", 0.85), (2, "imports", "import_style", 0.9), (2, "structure", "complexity", 0.9), (2, "structure", "structure_profile", 0.85)]
