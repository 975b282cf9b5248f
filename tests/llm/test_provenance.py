import pytest

from codeloom.llm import provenance as P

HAND = "export function go(a: number) {\n  if (a > 1) {\n    return a * 2;\n  }\n  return null;\n}\n"
CASES = [
    ("src/a.ts", HAND, []),
    ("src/a.ts", "// Copyright the x authors.\n// Use is governed by the licence file of this repository.\n" + HAND, []),
    ("src/generator/a.ts", "// helpers for the generated schema; edit freely\n" + HAND, []),
    ("src/a.ts", "// TODO: replace the generated types by our own\n" + HAND, []),
    ("src/vendors/a.ts", "// wraps the vendored client\n" + HAND, []),
    ("src/a-generated-id.ts", HAND, []),
    ("docs/generated-by-hand/a.ts", HAND, []),
    ("src/a.generated.ts", HAND, ["generated"]),
    ("src/gen/api/a.ts", HAND, ["generated"]),
    ("a/b_pb2.py", "x = 1\n", ["generated"]),
    ("src/a.ts", "// Code generated by protoc-gen-x. DO NOT EDIT.\n" + HAND, ["generated"]),
    ("src/a.py", "# @generated by x-codegen, do not edit\nx = 1\n", ["generated"]),
    ("src/a.go", "/*\n * This file was created automatically by the x schema compiler; manual changes will be lost.\n */\npackage a\n", ["generated"]),
    ("src/a.ts", "const s = '@generated by us, do not edit';\n" + HAND, []),
    ("third_party/x/a.ts", HAND, ["vendored"]),
    ("src/a.js", "/*!\n * abc v7.6.5 | (c) the def contributors | MIT licensed\n */\nlet x = 1;\n", ["vendored"]),
    ("src/a.js", "// Third-party copy of abc, version 1.2.3, origin def. See upstream for changes.\nlet x = 1;\n", ["vendored"]),
    ("lib/a.js", "(function(){" + "var a=function(e){return e?1:2};" * 60 + "})();", ["minified"]),
    ("lib/a.min.js", "", ["minified"]),
    ("src/a.py", "DATA = [\n" + "  12345, 23456, 34567, 45678,\n" * 40 + "]\n", ["data"]),
    ("src/a.go", '{\n  "a": {"b": 1, "c": true},\n  "d": null\n}', []),
    ("src/index.ts", "".join(f"import './part{i}/something';\n" for i in range(40)), []),
    ("src/a.ts", None, []),
    ("node_modules/x/a.ts", None, ["vendored"]),
    ("", "", []),
]


@pytest.mark.parametrize("path, text, want", CASES)
def test_kinds(path, text, want):
    assert P.kinds(path, text) == want


LONG = "".join(f"// line {i} of the licence\n" for i in range(60))
SQUEEZED = "let a = [" + "1, " * 1500 + "0];"


@pytest.mark.parametrize("text, want", [
    (LONG + "// Code generated by protoc-gen-x. DO NOT EDIT.\n" + HAND, ["generated"]),
    ("".join(f"import {{ a{i} }} from './a{i}';\n" for i in range(50)) + "// @generated by x-codegen, do not edit\n" + HAND, ["generated"]),
    (HAND * 100 + "// This file was created automatically by the x schema compiler; manual changes will be lost.", ["generated"]),
    (LONG + "/*!\n * abc v7.6.5 | (c) the def contributors | MIT licensed\n */\n" + HAND, ["vendored"]),
    (LONG + HAND + "// Vendored from abc at def 1.2.3 (upstream project ghi); local edits are not kept\n", ["vendored"]),
])
def test_late_notices(text, want):
    assert P.kinds("src/a.ts", text) == want


def test_notices_at_the_end_of_a_squeezed_line():
    assert "generated" in P.kinds("src/a.js", SQUEEZED + " /* Autogenerated from x.idl */")
    assert "vendored" in P.kinds("src/a.js", SQUEEZED + " /* @license abc-1.2.3 (c) def project, Apache-2.0 */")


@pytest.mark.parametrize("remark", ["the auto-generated id comes first", "auto-generated ids start at 1", "do not modify the list while it is walked", "nodes created by the compiler are kept", "unsaved changes are lost here", "the upstream project changed its API", "strips the @generated marker", "uses the third-party copy of zlib"])
def test_late_remarks_are_no_notices(remark):
    assert P.kinds("src/a.ts", LONG + HAND + f"// {remark}\n" + HAND) == []


GETTERS = "package a\n\n" + "".join(f"func (x *T) GetField{i}() int {{\n\tif x == nil {{\n\t\treturn {i}\n\t}}\n\treturn x.field{i}\n}}\n\n" for i in range(300))
ONE_LINE = "public class A {" + "".join(f" public int get{i}() {{ int a = {i}; return a; }}" for i in range(200)) + " }"
VARIED = "package a\n\n" + "".join(f"func step{i}() int {{\n" + "\tx := 1\n" * (i % 7 + 1) + "\treturn x\n}\n\n" for i in range(60))


def test_uniform_blocks_were_written_by_a_tool():
    assert P.kinds("src/a.go", GETTERS) == ["generated"]
    assert P.kinds("src/a.go", VARIED) == []
    m = P.measures(GETTERS, "go")
    assert m["uniformity"] > 0.99 and m["blocks"] == 300


def test_squeezed_text_of_any_language():
    assert "minified" in P.kinds("src/A.java", ONE_LINE)
    assert P.kinds("src/A.java", "public class A {\n" + "  int a;\n" * 5 + "}\n") == []


def test_canonical_layout():
    assert P.canonical("if (a;b) { x  =  1; y }\nelse\n{\n}", "javascript") == [(0, "if \x02a,b\x03{"), (1, "x = 1;"), (1, "y"), (0, "}"), (0, "else"), (0, "{"), (0, "}")]


def test_tables(spark, rows):
    files = [(i, f"/r/{p}" if p else None, p, "clash") for i, (p, _, _) in enumerate(CASES)]
    seen, inputs = set(), []
    for p, t, w in CASES:
        if p not in seen:
            seen.add(p)
            inputs.append((f"/r/{p}", t))
    f = spark.createDataFrame(files, "id bigint, path string, relative_path string, content string")
    i = spark.createDataFrame(inputs + inputs[:3], "path string, content string")
    first = {p: w for p, _, w in reversed(CASES)}
    want = sorted((n, ",".join(first[p])) for n, (p, _, _) in enumerate(CASES) if p and first[p])
    assert sorted((r.file_id, ",".join(r.kinds)) for r in P.classify(f, i).collect()) == want
    assert P.classify(f.where("false"), i).count() == 0
