import pytest

from codeloom.llm import syntax as S

GOOD = {
    "typescript": [
        "", "﻿// only a comment\r\n", "export const a: Array<{ x: number }> = [];\nexport type T = { a?: string } | null;\ninterface P extends Q<R> { readonly s: string }\nexport default class K<T extends object> implements P {\n  #p = 1;\n  private async *go(@Inject() a: number, ...b: string[]): Promise<void> { for await (const x of y) yield x!; }\n}\n",
        "export const View = ({ a }: Props) => (\n  <div className=\"x\">\n    <p>Don't {a} isn't it</p>\n    {a.map((x) => <b key={x}>{x}</b>)}\n  </div>\n);\n", "import type { A } from './a';\nimport x, { y as z } from \"b\";\nimport './c'\nexport * from './d'\nexport { x }\n", "declare module 'm' { export function f(a: string): void }\nabstract class A { abstract b(): void }\nenum E { A = 1, B }\n",
    ],
    "javascript": [
        "const re = /[{(]x\\)+/g.test(`a ${b} { ${`c`} }`);\nif (a) { b() } else if (c) d();\nfoo(1)\n", "#!/usr/bin/env node\n'use strict'\nmodule.exports = { a, b: async () => {}, get c() { return 1 } };\n", "label: for (const k in o) { continue label }\nvar x = a / b / c, y = a++ / 2;\n", "const s = 'it\\'s {';\n// don't (\n/* { */ export default function () {}\n", "switch (a) { case 'x': break; default: { y() } }\nnew Foo\n",
    ],
    "python": ["", "def f(a, *, b: int = 1) -> str:\n    return f\"{a!r:>{b}}\"\n", "# <<<<<<< HEAD\nx = '''\n=======\n'''\n", "match x:\n    case {'a': 1}:\n        pass\n"],
    "go": ["// c\npackage a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\ntype T[K any] struct {\n\ta int `json:\"{\"`\n}\n\nfunc (t *T) F(a, b int) (int, error) {\n\tfor i := range x {\n\t\tgo func() { c <- '{' }()\n\t}\n\treturn 1, nil\n}\n\nvar x = map[string]int{\"}\": 1}\nconst C = 1\n", "package p\nimport \"a\"\nfunc f()\ntype I interface{ M() }\nvar a, b int\n"],
    "java": ["package a.b;\n\nimport static a.B.*;\n\n@Ann(x = \"{\")\npublic final class A<T extends B> extends C implements D {\n  char c = '}';\n  String t = \"\"\"\n    { \"x\" }\n    \"\"\";\n  int f() { return 1; }\n}\n", "sealed interface S permits A {}\nrecord R(int a, String b) {}\nenum E { A, B }\n@interface N {}\n"],
    "rust": ["#![allow(dead_code)]\nuse a::{b, c as d};\n\n#[derive(Debug)]\npub struct S<'a> { x: &'a str }\nstruct T(u8);\nstruct U;\nimpl<'a> S<'a> { fn f(&self) -> char { '{' } }\npub(crate) async unsafe fn g<T: Into<String>>(x: [u8; 4]) -> Result<(), E> where T: Copy { r#\"}\"#; Ok(()) }\nmacro_rules! m { ($x:expr) => { $x }; }\nconst A: &[i64] = &[1];\nmod x;\ntrait Q { fn h(); }\nextern \"C\" { fn z(); }\nenum E { A(u8), B { c: u8 } }\nthread_local!{ static X: u8 = 1; }\n"],
    "cpp": ["#pragma once\n#include <a>\n#define X(a) \\\n  { a\nnamespace a::b {\ntemplate <typename T> class C : public D<T> { public: int f() const override { return '{'; } };\n}\nusing namespace std;\nstatic const int A[] = {1, 2};\nint main(int argc, char** argv) { auto s = R\"x(})x\"; return 1'000; }\nstruct P { int x; } p;\nenum class E { A };\nextern \"C\" { void f(); }\nA::A() : x(1) {}\n", "int f();\ntypedef int I;\nconstexpr int x = 1;\n"],
    "ruby": ["require 'a'\n\nclass A < B\n  attr_reader :if, :end\n  def f(x) = x + 1\n  def g(a, *b, k: 1, &c)\n    return if a.nil?\n    x = if a then 1 else 2 end\n    b.each do |y| puts \"#{y} {\" end\n    while a do break end\n    z = b.map { |q| q.end }\n    begin\n      h\n    rescue E => e\n      raise\n    ensure\n      i\n    end unless c\n    case x\n    when 1 then 2\n    else 3\n    end\n    t = <<~X\n      it's { def\n    X\n    %w[a b].freeze\n  end\nend\n", "x = 5 unless y\nputs 'a' if z\nfoo.do_it\n# if\n"],
}
BAD = {
    "typescript": ["function f( {", "const a = [1, 2;\n", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "export functi", "import { a } from", "const x = “a”;\n", "export interface P", "fn a(x: i64) -> i64 {\n  x\n}\n", "package a\n\nfunc f() {\n}\n", "<!DOCTYPE html>\n<html></html>", "{\n  \"a\": {\"b\": 1},\n  \"c\": null\n}", "def f(a):\n    return a\n", "# Title\n\nThe text says this.\n", "const s = `abc", "let y = 'abc;\n", "public class A {\n}\n", "const z ="],
    "javascript": ["function f(a: number) { return a; }\n", "interface A { b: string }\n", "const x: number = 1;\n", "foo(1))\n", "/* open\n", "require 'a'\n\ndef f\nend\n"],
    "python": ["def f(\n", "x = 'a\n", "{\n", "def f(a)\n    pass\n", "\x00"],
    "go": ["package a\nfunc f( {\n}\n", "func f() {}\n", "package a;\n\npublic class B {\n}\n", "{\"a\": {}}", "package a\n\nx := 1\n", "package a\nvar s = \"x\n", "package a\nfunc W"],
    "java": ["class A {", "package a\n\nfunc f() {\n}\n", "class A { } }", "import a.b\nclass C {}\n", "fn f() { }", "# Title\n\n- a `b`", "int f(int a) { return a; }\n"],
    "rust": ["fn f( {}", "package a.b;\n\npublic class C {\n}\n", "use a::b", "pub fn f", "{\"a\": {}}", "def f(a):\n    return {'b': 1}\n", "fn f() { \"x }"],
    "cpp": ["int f() {", "package a;\npublic class B {\n}\n", "fn f(x: i64) -> i64 {\n  x\n}\n", "# Title\n\nText goes on.\n", "{\"a\": {}}", "<!DOCTYPE html>\n<p>{a}</p>", "def f(a):\n  pass\n", "#include <a>\nint x", "import a from 'b';\nexport function f() {}\n"],
    "ruby": ["def f\n", "end\n", "class A\n  def f\n  end\n", "export function f(a) {\n}\n", "package a\n\nfunc f(x int) int {\n\treturn x\n}\n", "x = [1\n", "puts 'a\n", "fn f(a: i64) -> i64 {\n}\n", "def f(a):\n    return a\n", "if a\n  b\nend\nend\n"],
}


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_valid(language, text):
    assert S.parses(text, language)


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_broken(language, text):
    assert not S.parses(text, language)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_chunks_compose_to_the_same(size):
    for language, texts in (*GOOD.items(), *BAD.items()):
        for t in texts:
            if language in ("ruby", "python"):
                continue  # words of a statement may be cut there
            if "`" in t or '"""' in t or "R\"" in t or "r#" in t or "\\\n" in t:
                continue
            assert S.parses(t, language, size) == S.parses(t, language), (language, t)


OVER_LINES = {
    "cpp": ['#include <a>\nconst char* s = R"x(\n{ " (\n)y"\n)x";\nint f() {\n  return 1;\n}\n'],
    "ruby": ["=begin\ndef f \" {\n'\n=end\nA = %w[\n  a'b\n  c\n]\ndef f\n  1\nend\n"],
    "rust": ['const A: &str = r#"\n" { "\n"#;\nfn f() {\n  g();\n}\n'],
    "typescript": ["const a = `x\n${b ? `{\n${c}\n` : `\n`}\n(`;\nf(a);\n"],
    "java": ['class A {\n  String t = """\n    { " \\""" (\n    """;\n}\n'],
    "go": ["package a\n\nvar s = `\n\"{\n/*\n`\n"],
}


@pytest.mark.parametrize("size", [1, 7, 40])
def test_all_chunks_compose_to_the_same(size):
    for cases in (GOOD, BAD, OVER_LINES):
        for language, texts in cases.items():
            for t in texts:
                assert S.parses(t, language, size) == S.parses(t, language, len(t) + 1), (language, t)
                if language != "python":
                    code = S.blank(S.prepare(t, language), language)
                    assert "".join(S.blank(c, language) for c in S.cut_chunks(S.prepare(t, language), language, size)) == code


def test_long_files_with_strings_over_chunks(spark, rows):
    texts = [(f"p/{lang}.{ext}", OVER_LINES[lang][0]) for lang, ext in (("cpp", "cpp"), ("ruby", "rb"), ("rust", "rs"), ("typescript", "ts"), ("java", "java"), ("go", "go"))]
    assert all(S.parses(t, S.language_of(p), len(t) + 1) for p, t in texts)
    texts.append(("p/open.rs", "const A: &str = \"\n" * 9))
    files = spark.createDataFrame([(i, 1, p) for i, (p, _) in enumerate(texts)], "id bigint, project_id bigint, path string")
    checked = S.check(files, spark.createDataFrame(texts, "path string, content string"), chunk=16)
    assert rows(checked.select("file_id", "broken")) == [(i, i == 6) for i in range(7)]


def test_compose_is_associative():
    parts = [S.summarise(t, "", "go") for t in ("f(\n", "a) { [\n", "] }\n", "(\n", "})\n")]
    for i in range(3):
        a, b, c = parts[i : i + 3]
        assert S.compose(S.compose(a, b), c) == S.compose(a, S.compose(b, c))


def test_tables(spark, rows):
    long = "package a\n" + "func f() {\n\tx := `{\n`\n}\n" * 40
    inputs = [("p/a.go", long), ("p/b.go", long + "}"), ("p/c.py", "x = ("), ("p/d.py", ""), ("p/e.txt", "("), ("p/f.ts", None), (None, "x"), ("p/a.go", long), ("p/h.rs", "/*" + "x\n" * 300)]
    files = [(i, 1, p, "clash") for i, p in enumerate(["p/a.go", "p/b.go", "p/c.py", "p/d.py", "p/e.txt", "p/f.ts", None, "p/none.ts", "p/h.rs"])]
    f = spark.createDataFrame(files, "id bigint, project_id bigint, path string, content string")
    i = spark.createDataFrame(inputs, "path string, content string")
    c = S.check(f, i, chunk=64)
    assert rows(c.select("file_id", "language", "broken")) == [(0, "go", False), (1, "go", True), (2, "python", True), (3, "python", False), (8, "rust", True)]
    assert rows(S.rates(c).where("project_id is null")) == [(None, "go", 2, 1, 0.5), (None, "python", 2, 1, 0.5), (None, "rust", 1, 1, 1.0)]
    assert S.check(f.where("false"), i).count() == 0
