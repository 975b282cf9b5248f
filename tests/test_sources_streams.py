import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from codeloom.session import cut, release, small
from codeloom.sources import code_tree as T
from codeloom.sources import sinks as K
from codeloom.sources import traces as R
from codeloom.sources.config import Settings
from codeloom.sources.tables import current_files
from codeloom.streaming import counters as C
from codeloom.streaming import expiry as X


def test_tree(spark, rows, tmp_path):
    for p, t in (("src/a.ts", "let x;"), ("node_modules/b.ts", "no"), ("c.py", "x = 1\n"), ("d.txt", "no")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    f = T.scan(spark, str(tmp_path))
    assert rows(f.select("relative_path", "language", "size_bytes", "content")) == [("c.py", "python", 6, "x = 1\n"), ("src/a.ts", "typescript", 6, "let x;")]
    state = f.where("language = 'python'").select("path", (F.col("modified") + F.expr("interval 1 day")).alias("last_scanned"))
    assert rows(T.changed_since(f, state).select("relative_path")) == [("src/a.ts",)]


def test_manifests_and_records(spark, rows, tmp_path):
    (tmp_path / "package.json").write_text(json.dumps({"dependencies": {"a": "^1.2.3", "b": "2.0.0"}, "devDependencies": {"a": "~1.3.0"}}))
    (tmp_path / "one.md").write_text("# Use Spark\n\nStatus: Accepted\nDate: 2025-01-02\n")
    m = T.manifests(spark, str(tmp_path)).select("kind", "package", "version")
    assert rows(m) == [("dev", "a", "1.3.0"), ("prod", "b", "2.0.0")]
    assert rows(T.decision_records(spark, str(tmp_path)).select("title", "status", "date")) == [("Use Spark", "accepted", "2025-01-02")]
    p = m.select("package", "version", "kind")
    for style in ("spdx", "cyclonedx", "json"):
        assert K.sbom_valid(K.sbom(p, style, "x").first().text, style)
    (tmp_path / "tsconfig.json").write_text(json.dumps({"compilerOptions": {"paths": {"@/*": ["./src/*"]}}}))
    assert T.aliases(spark, str(tmp_path / "tsconfig.json")) == [("@/", "src/")]


def test_traces(spark, rows, tmp_path):
    e = {"fromFunctionName": "a", "toFunctionName": "b", "workloadId": "w", "callCount": 0}
    for name, x in (("1.json", [e]), ("2.json", {"calls": [e | {"staticMissed": True}]}), ("3.json", {"events": [e | {"callCount": 4}]}), ("4.json", "nothing")):
        (tmp_path / name).write_text(json.dumps(x) if name != "4.json" else x)
    assert rows(R.normalize(R.load(spark, str(tmp_path)))) == [("a", "b", "w", 6, True)]
    lines = spark.createDataFrame([("ok",), (json.dumps(e),), ("{broken",), ('{"type":"log"}',)], "value string")
    assert R.from_lines(lines).count() == 1


def test_settings():
    assert Settings.load('{"top_k": 3}').top_k == 3 and Settings.load(None).budget_tokens == 8000
    for bad in ('{"nope": 1}', '{"top_k": "x"}'):
        with pytest.raises(ValueError):
            Settings.load(bad)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b"), (2, None)], "id int, name string")
    K.write_csv(df, str(tmp_path / "c"))
    K.write_json(df, str(tmp_path / "j"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == 2
    assert K.markdown_table(df, ["id"]).first().text.split("\n")[2:] == ["| 1 | a<b |", "| 2 |  |"]
    assert "<td>a&lt;b</td>" in K.html_table(df, ["id"]).first().text
    g = K.d3_graph(spark.createDataFrame([("m",)], "module string"), spark.createDataFrame([("m", "n", 2)], "a string, b string, links int")).first().text
    assert json.loads(g) == {"nodes": [{"id": "m"}], "links": [{"source": "m", "target": "n", "value": 2}]}


def test_current_files(spark, rows):
    t = dt.datetime(2025, 1, 1)
    f = spark.createDataFrame([(1, "a", 1, t, "old"), (1, "b", 1, t + dt.timedelta(1), "new"), (1, "b", 1, t + dt.timedelta(1), "new"), (2, "c", None, None, "x"), (None, "d", 1, t, "y")], "id bigint, hash string, size_bytes bigint, last_scanned timestamp_ntz, path string")
    assert rows(current_files(f, "path")) == [(1, "new"), (2, "x")]


def test_cut_and_small(spark):
    df = cut(spark.range(10))
    assert df.count() == 10 and small(df, 10) and not small(df, 9)
    release(df)


def test_stream_counts_equal_batch(spark, rows, tmp_path):
    e = spark.createDataFrame([(i, dt.datetime(2025, 1, 1) + dt.timedelta(hours=i), i % 3, "ab"[i % 2], 1.0, None) for i in range(60)], C.EVENTS)
    e.repartition(5).write.parquet(str(tmp_path / "in"))
    s = C.call_counter(C.events_stream(spark, str(tmp_path / "in")), ["user_id"], "value")
    C.run_once(s, "update", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(C.latest_of(spark, str(tmp_path / "out"), ["user_id"]).select("user_id", "total")) == rows(C.call_counter(e, ["user_id"], "value").select("user_id", "total"))
    assert C.sliding(e).count() > C.tumbling(e).count() and C.sessions(e).count() == 3


def test_expiry(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    rows_ = [("s", "k", 1.0, at), ("s", "k", 2.0, at + dt.timedelta(days=1)), ("s", "late", 9.0, at + dt.timedelta(days=30))]
    for i, r in enumerate(rows_ + [("s", "end", 1.0, at + dt.timedelta(days=60))]):
        spark.createDataFrame([r], "scope string, key string, value double, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(0.05 * i)
    s = X.memory_state(C.events_stream(spark, str(tmp_path / "in"), "scope string, key string, value double, ts timestamp_ntz"))
    C.run_once(s, "update", str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.key, r.state) for r in spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")).collect()}
    assert ("k", "live") in got and ("k", "expired") in got and ("end", "expired") not in got
