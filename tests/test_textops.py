from pyspark.sql import functions as F

from codeloom.operators import textops as X


def test_diff_and_imports(spark, rows):
    d = spark.createDataFrame([(1, "a\nb", "a\nc\nd"), (2, None, ""), (3, "x", "x")], "k int, o string, n string")
    assert rows(X.line_diff(d, "o", "n", "k")) == [(1, 2, "b", "c"), (1, 3, None, "d")]
    t = spark.createDataFrame([("x = 1\nimport b from 'b';\nimport a from 'a';\nimport b from 'b';\n",), ("y",), (None,)], "t string")
    assert [r[0] for r in t.select(X.organize_imports(F.col("t"))).collect()] == ["import a from 'a';\nimport b from 'b';\n\nx = 1\n", "y", None]


def test_verdicts(spark):
    t = spark.createDataFrame([("VERDICT: FAIL\nCONFIDENCE: 0.8\nSUGGESTIONS:\n- one\n2. two\n",), ("no idea",)], "t string")
    got = [r[0] for r in t.select(X.parse_verdict(F.col("t"))).collect()]
    assert (got[0].verdict, got[0].confidence, got[0].suggestions) == ("fail", 0.8, ["one", "two"])
    assert (got[1].verdict, got[1].confidence, got[1].suggestions) == ("warn", 0.5, [])


def test_rest(spark, rows):
    s = spark.createDataFrame([("a", "class", "B"), ("a", "function", "f")], "path string, kind string, name string")
    r = X.scaffolds(s).first()
    assert r.docs == "# a\n\n## B (class)\n## f (function)" and r.tests.count("it(") == 2
    f = spark.createDataFrame([(1, "core/graph.ts", 0.1), (2, "core/x.ts", None), (3, "y", 1.0)], "id bigint, relative_path string, cognitive_load double")
    assert [r.id for r in X.onboarding(f, ["core", "graph"]).collect()] == [1, 2]
    u = spark.createDataFrame([("https://api.example.org/x",), ("http://api.example.org",), ("https://example.org.evil.net",), (None,), ("nonsense",)], "u string")
    assert [r[0] for r in u.select(X.url_allowed(F.col("u"), ["example.org"])).collect()] == [True, False, False, False, False]
    v = spark.createDataFrame([("^4.9.0", "5.0.1"), ("5.1", "5.9"), (None, "1")], "a string, b string")
    assert [r[0] for r in v.select(X.major_upgrade(F.col("a"), F.col("b"))).collect()] == [True, False, None]
    assert [r[0] for r in spark.createDataFrame([("30-45 min",), ("soon",)], "t string").select(X.minutes_of(F.col("t"))).collect()] == [30, None]
    assert X.contract_cases([{"id": "c", "forbidden": ["x"], "max_lines": 2}]) == [("c", "forbidden", "x", True), ("c", "max_lines", "\n\n", True)]
