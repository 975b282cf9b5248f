"""Errors that leave brackets and quotes balanced, and valid texts that look like them."""

import pytest

from codeloom.llm import syntax as S

INSIDE = [
    ("typescript", "let x = ;"), ("typescript", "if (a ==) { b(); }"), ("javascript", "foo(1,, )"), ("go", "package a\nfunc f() {\n\tx := := 1\n}\n"), ("java", "class A { void f( {} ) }"), ("rust", "fn f() { let = 3; }"),
    ("typescript", "const x: = 3"), ("java", "class A { void f() { int x = ; } }"), ("cpp", "int f() { return a ==; }"), ("rust", "fn f() { foo(1,,2); }"), ("go", "package a\nfunc f() { if x == { } }"),
    ("java", "class A { int f() { return 1 + ; } }"), ("javascript", "const f = (a, b) => { return a +; };"), ("cpp", "int f() { int x = = 3; }"), ("typescript", "foo(a b)"), ("rust", "fn f() { let x = 3\n let y = 4; }"),
    ("java", "class A { void f() { int x = 3\n return; } }"), ("go", "package a\nfunc f() { x = 1 2 }"), ("javascript", "function f() { const = 5; }"), ("cpp", "void f() { g(, 1); }"), ("java", "class A { void f() { g(1,); } }"),
    ("rust", "fn f() { match x { 1 => , } }"), ("typescript", "function f(a: number,, b) {}"), ("go", "package a\nfunc f(a int,, b int) {}"), ("ruby", "f(1,, 2)\n"), ("ruby", "x = == 1\n"), ("rust", "fn f() { g(a b) }"),
]
UNUSUAL = [
    ("javascript", "const [, b] = x, c = [1,,2], d = a => ({}), e = a || {}, f = !(!a), g = a\n  ? b : c;\nfor (;;) {}\n"),
    ("typescript", "type A = | 'a' | 'b';\ntype B = { -readonly [K in T]-?: X };\nconst f = <T,>(x: T) => x as T;\nlet g = a!;\nfunction h(this: X, a = 1, ...b: []) {}\n"),
    ("rust", "fn f() { let g = || 1; let h = |a, b| a + b; let i = &&x; for j in 0..3 { } let k = x[1..]; let l = *p; if a && !b {} S { ..d } }\n"),
    ("cpp", "auto f = [=](int&&, char*) { return a<b>(c); };\nbool operator==(const A&, const B&);\nA& operator=(A&&) = default;\nint x = {};\n"),
    ("java", '@A({"x", "y"})\nclass B<T extends C & D> {\n  int[] a = {1, 2,};\n  @Override\n  public List<?> f(final int x) {\n    if (x > 1)\n      return null;\n    return (y) -> { };\n  }\n}\n'),
    ("go", "package a\n\nfunc f(c chan<- int, d ...int) (x, y int) {\n\tc <- 1\n\tx, y = 1, 2\n\tg(d...)\n\treturn\n}\n"),
    ("ruby", "a, = f\nb ||= c\nd = !e\ng(*h, **i, &j)\nk = l == m\n"),
]


@pytest.mark.parametrize("language, text", INSIDE)
def test_errors_inside_balanced_brackets(language, text):
    assert not S.parses(text, language)


@pytest.mark.parametrize("language, text", UNUSUAL)
def test_valid_although_unusual(language, text):
    assert S.parses(text, language)


def test_python_in_pieces():
    text = "import a\n\n@b\ndef f(x,\n      y):\n    return '''\nz\n'''\n\nif f:\n    1\nelse:\n    2\nc = {\n'd': [\n1]}\n"
    for size in (1, 10, 40):
        assert S.parses(text, "python", size) and not S.parses(text + "def g(:\n  pass\n", "python", size)
        assert not S.parses(text.replace("    2\n", "2\n"), "python", size)
