"""Structure of source files: top-level functions, classes, imports; a search over them; rewriting of spans."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Declarations at the start of a line, by language (kind, pattern with the name).
DECLARATIONS = {
    "typescript": (("function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"), ("class", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"), ("interface", r"^(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"), ("import", r"^import\s+(?:[^'\"\n]*?\sfrom\s+)?['\"]([^'\"\n]+)['\"]"), ("import", r"^\}\s*from\s+['\"]([^'\"\n]+)['\"]"), ("import", r"^(?:const|let|var)\s+[\w${},\s]+=\s*require\(['\"]([^'\"\n]+)['\"]\)")),
    "go": (("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("class", r"^type\s+(\w+)\s+(?:struct|interface)\b"), ("import", r"^(?:import\s+|\t)(?:[\w.]+\s+)?\"([^\"\n]+)\"\s*$")),
    "java": (("function", r"^[ \t]+(?!(?:return|new|else|throw|case)\b)(?:(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)*(?:<[^<>()]*(?:<[^<>()]*>)?[^<>()]*>\s*)?[\w.<>\[\],? ]+[\s>\]](\w+)\s*\([^(){};]*\)\s*(?:throws\s+[\w., ]+)?\s*\{"), ("function", r"^[ \t]+(?:(?:public|protected|private)\s+)(\w+)\s*\([^(){};]*\)\s*(?:throws\s+[\w., ]+)?\s*\{"), ("class", r"^(?:public\s+|abstract\s+|final\s+)*(?:class|interface|enum|record)\s+(\w+)"), ("import", r"^import\s+(?:static\s+)?([\w.*]+)\s*;")),
    "csharp": (("function", r"^[ \t]+(?!(?:return|new|else|throw|case)\b)(?:(?:public|protected|private|internal|static|virtual|override|async|sealed|abstract)\s+)+[\w.<>\[\],? ]+[\s>\]?](\w+)\s*(?:<[\w, ]+>)?\([^(){};]*\)\s*(?:\{|=>|where\b)"), ("class", r"^[ \t]*(?:(?:public|internal|private|protected|static|sealed|abstract|partial)\s+)*(?:class|interface|struct|record|enum)\s+(\w+)"), ("import", r"^using\s+(?:static\s+)?([\w.]+)\s*;")),
    "rust": (("function", r"^(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)"), ("class", r"^(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"), ("import", r"^(?:pub\s+)?use\s+([^;]+);")),
    "cpp": (("function", r"^(?!return\b|else\b|using\b|namespace\b)[\w:<>,*&\s]+?[\s*&]([A-Za-z_]\w*)\s*\([^;{]*\)\s*(?:const\s*)?\{"), ("class", r"^(?:class|struct)\s+(\w+)[^;]*\{?\s*$"), ("import", r"^#\s*include\s*[<\"]([^>\"\n]+)[>\"]")),
    "ruby": (("function", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)"), ("class", r"^\s*(?:class|module)\s+([A-Z]\w*)"), ("import", r"^require(?:_relative)?\s+['\"]([^'\"\n]+)['\"]")),
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
_COMPILED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in DECLARATIONS.items()}
_BRANCH = re.compile(r"\b(?:if|for|while|case)\b|&&|\|\||(?<![?.:])\?(?![?.:])")
EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "java": "java", "rs": "rust", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "h": "cpp", "rb": "ruby", "rake": "ruby", "cs": "csharp"}
NODES = "path string, language string, kind string, name string, start_line int, end_line int, offset bigint, length bigint, complexity int, text string"


def _python_nodes(text: str) -> list[tuple]:
    try:
        tree = ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError):
        return []
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    out = []
    for n in tree.body:
        a, b = starts[n.lineno - 1], starts[min(n.end_lineno, len(starts) - 1)] - 1
        names = []
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            names = [("function", n.name)]
        elif isinstance(n, ast.ClassDef):
            names = [("class", n.name)]
        elif isinstance(n, ast.Import):
            names = [("import", x.name) for x in n.names]
        elif isinstance(n, ast.ImportFrom):
            names = [("import", "." * n.level + (n.module or ""))]
        cc = 1 + sum(isinstance(x, (ast.If, ast.IfExp, ast.For, ast.While, ast.BoolOp, ast.match_case)) for x in ast.walk(n)) if names and names[0][0] == "function" else 1
        out += [(kind, name, n.lineno, n.end_lineno, a, b - a, cc) for kind, name in names]
    return out


#: Comments, and strings, by family of languages; what stands in them is no code.
_STRINGS = r'"(?:[^"\\\n]|\\[\s\S])*"|' + r"'(?:[^'\\\n]|\\[\s\S])*'"
_NO_CODE = {
    "ruby": re.compile(rf"(?P<c>(?m:^=begin\b[\s\S]*?^=end\b)|(?<![\w$])#(?!\{{)[^\n]*)|{_STRINGS}"),
    "rust": re.compile(r'(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|r(#+)"[\s\S]*?"\2|"(?:[^"\\]|\\[\s\S])*"' + r"|'(?:[^'\\\n]|\\[^\n]+?)'"),
    "other": re.compile(rf"(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|{_STRINGS}|`(?:[^`\\]|\\[\s\S])*`"),
}


def _plain(text: str, language: str, strings: bool) -> str:
    """The text with comments (and strings) as blanks of the same length, line ends kept: places stay what they were."""

    def blank(m: re.Match) -> str:
        if m["c"] is None and not strings:
            return m[0]
        return re.sub(r"[^\n]", " ", m[0])

    return _NO_CODE.get(language, _NO_CODE["other"]).sub(blank, text)


def nodes_of(path: str, text: str | None) -> list[tuple]:
    """(kind, name, start_line, end_line, offset, length, complexity) of the declarations of a text, in order; nothing
    for unknown extensions, null and malformed texts. What stands in comments is no declaration, and what stands in
    comments or strings no branch."""
    language = EXTENSIONS.get((path or "").rpartition(".")[2].lower())
    if not language or not text:
        return []
    if language == "python":
        return _python_nodes(text)
    said, code = _plain(text, language, False), _plain(text, language, True)
    found = sorted({(m.start(), m.end(), kind, m[1]) for kind, p in _COMPILED[language] for m in p.finditer(said if kind == "import" else code)})
    found = [f for i, f in enumerate(found) if i == 0 or f[0] != found[i - 1][0]]
    out = []
    for i, (a, b, kind, name) in enumerate(found):
        end = b
        if kind in ("function", "class", "interface"):
            after = next((x[0] for x in found[i + 1 :] if x[2] in ("function", "class", "interface")), len(text))
            end = _block_end(code, a, after, language != "ruby")
        start_line = text.count("\n", 0, a) + 1
        out.append((kind, name, start_line, start_line + text.count("\n", a, end), a, end - a, 1 + len(_BRANCH.findall(code, a, end)) if kind == "function" else 1))
    return out


_BRACE = re.compile(r"[{}()]")


def _block_end(code: str, start: int, after: int, braces: bool = True) -> int:
    """Where the block that begins behind start ends: at its last brace (those within round brackets are none of it) or, if it
    has none, before the next declaration."""
    depth = round_ = 0
    for m in _BRACE.finditer(code, start) if braces else ():
        if depth == 0 and m.start() >= after:
            break
        if m[0] in "()":
            round_ += 1 if m[0] == "(" else -1
        elif round_ <= 0:
            depth += 1 if m[0] == "{" else -1
            if depth <= 0:
                return m.end()
    return start + len(code[start:after].rstrip())


def parse(texts: DataFrame, key: str = "path") -> DataFrame:
    """A row per declaration: NODES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, EXTENSIONS.get(p.rpartition(".")[2].lower()), *n, t[n[4] : n[4] + n[5]]) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n in nodes_of(p, t)]
            types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in NODES.split(", ")])

    return texts.where(F.col(key).isNotNull() & F.col("content").isNotNull()).select(F.col(key).alias("path"), "content").mapInArrow(run, NODES)


def search(nodes: DataFrame, kind: str | None = None, name: str | None = None, contains: str | None = None, modifier: str | None = None, files: str | None = None, limit: int = 50) -> DataFrame:
    """The first `limit` nodes, by path and offset, that fit all conditions given."""
    x = nodes
    if kind:
        x = x.where(F.col("kind") == kind)
    if name:
        x = x.where(F.col("name").rlike(name))
    if contains:
        x = x.where(F.contains("text", F.lit(contains)))
    if modifier:
        word = modifier.removesuffix("Keyword").lower()
        x = x.where(F.substring_index("text", "(", 1).rlike(rf"(?:^|\s){word}\s"))
    if files:
        x = x.where(F.col("path").rlike(files))
    return x.orderBy("path", "offset").limit(limit)


def replace(texts: DataFrame, matches: DataFrame, replacement: str, key: str = "path") -> DataFrame:
    """path, replaced, content: texts with the spans of matches (path, offset, length) replaced. Inputs stay as they are.
    Spans are taken from the last to the first; of overlapping ones the later wins."""
    spans = matches.groupBy("path").agg(F.sort_array(F.collect_set(F.struct("offset", "length")), asc=False).alias("spans"))
    start = F.struct(F.col("content").alias("t"), F.lit(2**62).alias("at"), F.lit(0).alias("n"))

    def step(acc, s):
        fits = s["offset"] + s["length"] <= acc["at"]
        put = F.concat(F.substr(acc["t"], F.lit(1), s["offset"].cast("int")), F.lit(replacement), F.substr(acc["t"], (s["offset"] + s["length"] + 1).cast("int")))
        return F.when(fits, F.struct(put.alias("t"), s["offset"].alias("at"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    return texts.select(F.col(key).alias("path"), "content").join(spans, "path").select("path", F.aggregate("spans", start, step).alias("r")).select("path", F.col("r.n").alias("replaced"), F.col("r.t").alias("content"))
