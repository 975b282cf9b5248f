import datetime as dt

from pyspark.sql import functions as F

from codeloom.operators import references as R
from codeloom.operators import resolve as V

T = [dt.datetime(2025, 1, d) for d in range(1, 29)]
FILES = "id bigint, project_id bigint, relative_path string, hash string, last_scanned timestamp_ntz, extra int"


def frames(spark, files, functions=(), imports=(), calls=(), deletions=()):
    return (
        spark.createDataFrame(list(files), FILES),
        spark.createDataFrame(list(functions), "id bigint, file_id bigint, name string"),
        spark.createDataFrame(list(imports), "id bigint, file_id bigint, source string, resolved_path string, key int"),
        spark.createDataFrame(list(calls), "id bigint, to_function_id bigint, detected_at timestamp_ntz"),
        spark.createDataFrame(list(deletions), "entity string, entity_id bigint, deleted_at timestamp_ntz"),
    )


def test_calls(spark, rows):
    f = [(1, 1, "a.ts", "h", T[4], 0), (1, 1, "a.ts", "g", T[2], 0), (2, 1, "b.ts", "h", T[4], 0), (3, 1, "c.ts", "h", T[9], 0)]
    fn = [(10, 1, "x"), (10, 1, "x"), (20, 2, "y"), (30, 3, "z")]
    calls = [(1, 10, T[5]), (2, 10, T[1]), (3, 99, T[5]), (4, 20, T[5]), (5, 20, T[7]), (6, 30, T[12]), (7, 10, None), (8, None, T[3]), (3, 99, T[5])]
    dele = [("file", 2, T[6]), ("function", 30, T[12]), ("file", 3, T[8])]
    got = rows(R.dangling(*frames(spark, f, fn, (), calls, dele)).select("ref_table", "ref_id", "reason", "month"))
    assert got == [("calls", 2, "late", "2025-01"), ("calls", 3, "missing", "2025-01"), ("calls", 5, "deleted", "2025-01"), ("calls", 6, "deleted", "2025-01"), ("calls", 8, "missing", "2025-01")]


def test_imports(spark, rows):
    f = [(1, 1, "src/app/main.ts", "h", T[1], 0), (2, 1, "src/lib/index.jsx", "h", T[1], 0), (3, 1, "src/x.tsx", "h", T[1], 0), (4, 1, "gone.ts", "h", T[1], 0), (5, 2, "src/other.ts", "h", T[1], 0), (6, 1, "index.ts", "h", T[1], 0)]
    imports = [
        (1, 1, "../lib", None, 0), (2, 1, "../x.jsx", None, 0), (3, 1, "../x", None, 0), (4, 1, "../X", None, 0), (5, 1, "react", None, 0), (6, 1, "react", "./src\\\\lib//index.jsx", 0),
        (7, 1, "../../gone", None, 0), (8, 1, "../other", None, 0), (9, 1, "./main.js", None, 0), (10, 1, "../../../../etc", None, 0), (11, 1, "../..", None, 0), (12, 1, None, None, 0), (13, 77, "./a", None, 0),
    ]
    got = rows(R.dangling(*frames(spark, f, (), imports, (), [("file", 4, T[2])])).select("ref_id", "reason"))
    assert got == [(10, "missing"), (13, "missing"), (4, "missing"), (7, "deleted"), (8, "missing")]
    states = R.file_states(frames(spark, f)[0], frames(spark, f)[4])
    res = {r.ref_id: r.resolved_id for r in V.resolve_imports(frames(spark, f, (), imports)[2], states).collect()}
    assert (res[1], res[2], res[3], res[4], res[5], res[6], res[9], res[11]) == (2, 3, 3, None, None, 2, 1, 6)


def test_empty_tables(spark, rows):
    assert rows(R.dangling(*frames(spark, ()))) == []


def test_intervals(spark, rows):
    refs = spark.createDataFrame([(1, "a", T[0]), (2, "a", T[5]), (3, "a", T[9]), (4, "b", T[1]), (5, None, T[1])], "n int, k string, at timestamp_ntz")
    par = spark.createDataFrame([("a", T[3], T[8])], "k string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    assert rows(R.orphans(refs, par, "k", "at", ["n"]).select("n", "reason")) == [(1, "late"), (3, "deleted"), (4, "missing"), (5, "missing")]


def test_reopened_touching_and_empty_intervals(spark, rows):
    refs = spark.createDataFrame([(n, k, T[n]) for k in "abcd" for n in range(0, 20)] + [(30, "a", None), (31, "z", None)], "n int, k string, at timestamp_ntz")
    par = [("a", T[2], T[5]), ("a", T[8], None), ("b", T[2], T[5]), ("b", T[5], T[7]), ("b", T[3], T[4]), ("b", T[2], T[5]), ("c", T[9], T[4]), ("c", T[10], T[12]), ("d", None, T[3]), ("d", T[5], T[5]), (None, T[1], None)]
    got = rows(R.orphans(refs, spark.createDataFrame(par, "k string, valid_from timestamp_ntz, valid_to timestamp_ntz"), "k", "at", ["n", "k"]).select("k", "n", "reason"))

    def want(k, n):
        own = [(a or T[0], b) for x, a, b in par if x == k]
        if any(a <= T[n] and (b is None or T[n] < b) for a, b in own):
            return None
        return "deleted" if any(min(a, b or a) <= T[n] for a, b in own) else "late"

    assert got == sorted([(k, n, want(k, n)) for k in "abcd" for n in range(20) if want(k, n)] + [("z", 31, "missing")], key=repr)


def test_a_hot_key_over_many_ranges(spark):
    """One key has most references: its ranges hold no start of the interval, which is carried into them."""
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        refs = spark.range(4000).select(F.col("id").alias("n"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id") % 70)).otherwise("hot").alias("k"), F.expr("timestamp_ntz'2025-01-01' + make_dt_interval(0, 0, 0, id % 1000)").alias("at"))
        par = spark.sql("select 'hot' k, timestamp_ntz'2025-01-01 00:05:00' valid_from, timestamp_ntz'2025-01-01 00:10:00' valid_to union all select 'k0', null, null")
        got = R.orphans(refs, par, "k", "at", ["n", "k"])
        hot = "case when n % 1000 < 300 then 'late' when n % 1000 >= 600 then 'deleted' end"
        want = refs.selectExpr("n", "k", f"case when k = 'hot' then {hot} when k <> 'k0' then 'missing' end reason").where("reason is not null")
        a, b = got.select("n", "k", "reason"), want
        assert a.count() == b.count() and a.exceptAll(b).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_aliases(spark):
    df = spark.createDataFrame([("@/a",), ("~b",), ("c",)], "s string")
    assert [r[0] for r in df.select(V.apply_aliases(F.col("s"), [("@/", "src/"), ("~", "lib/")])).collect()] == ["src/a", "lib/b", "c"]
