import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import embedding as E
from codeloom.functions import paths as P
from codeloom.functions import scalars as S


def one(spark, expr, *values, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expr).collect()]


def test_paths(spark):
    c = F.col("s")
    assert one(spark, P.fold(c), "a/./b//c", "a\\b\\..\\c", "../x", "", None, "a/../../b", "./a/..") == ["a/b/c", "a/c", None, "", None, None, ""]
    assert one(spark, P.dirname(c), "a/b.ts", "b.ts") == ["a", ""]
    assert one(spark, P.extension(c), "a/b.TS", "a.b/c", ".bashrc") == ["ts", "", ""]
    assert one(spark, P.module_of(c), "a/b.ts", "b.ts") == ["a", "."]


def test_scalars(spark):
    c = F.col("s")
    assert one(spark, S.rolling_hash32(c), "hello world", "", None)[:2] == [1794106052, 0]
    assert one(spark, S.naming_convention(c), "fooBar", "FooBar", "foo_bar", "FOO_BAR", "foo-bar") == ["camelCase", "PascalCase", "snake_case", "SCREAMING_SNAKE", "unknown"]
    assert one(spark, S.half_up(F.col("s")), -2.5, 2.5, schema="s double") == [-2.0, 3.0]
    assert one(spark, S.language_of(c), "x.tsx", "y.rb", "Makefile", "a.rake") == ["typescript", "ruby", "unknown", "unknown"]
    assert one(spark, S.xml_escape(c), '<a b="&">') == ["&lt;a b=&quot;&amp;&quot;&gt;"]
    assert one(spark, F.to_json(S.json_or_text(c)), '{"a": 1}', "plain") == ['{"a":1}', '{"text":"plain"}']


@pytest.mark.parametrize(
    "glob, path, hit",
    [("src/core/**/*.ts", "src/core/engine.ts", True), ("src/core/**/*.ts", "src/core/a/b/c.ts", True), ("src/core/**/*.ts", "src/cli/a.ts", False), ("*.ts", "a/b.ts", False), ("a?.ts", "ab.ts", True), ("a.b", "axb", False)],
)
def test_globs(spark, glob, path, hit):
    assert one(spark, F.col("s").rlike(S.glob_regex(glob)), path) == [hit]


def test_globs_compat(spark):
    r = S.glob_regex("src/core/**/*.ts", compat=True)
    assert one(spark, F.col("s").rlike(r), "src/core/engine.ts", "src/core/debt/tracker.ts", "src/core/debt/detection/genome.ts") == [False, True, False]
    assert one(spark, F.col("s").rlike(S.glob_regex("**/*.ts", compat=True)), "any/thing.py") == [True]


def test_keywords(spark):
    assert one(spark, S.keyword_match(F.col("s"), "process.exit("), "process.exit(1)", "process_exit(1)") == [True, False]
    assert one(spark, S.keyword_match(F.col("s"), r"eval\s*\("), "EVAL (x)", "evil(x)") == [True, False]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [-1.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0], [0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0]


@given(st.text(max_size=60))
@settings(max_examples=40, deadline=None)
def test_embedder_is_a_unit_vector_or_zero(text):
    v = E.embed(text, 32)
    n = math.sqrt(sum(x * x for x in v))
    assert len(v) == 32 and (abs(n - 1) < 1e-6 or not any(v))


def test_embedder(spark):
    assert E.word_hash("hello world") == 1794106052 and E.word_hash("polygenelubricants") == -(2**31)
    got = one(spark, E.code_embedding(F.col("s"), 16), "a // b\n/* c */ a", "a a", None)
    assert np.allclose(got[0], got[1]) and not any(got[2])
