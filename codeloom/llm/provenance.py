"""Generated, minified, vendored and data files.

Each file is lexed: comments and strings become single marks, and what is left is emitted again in the canonical layout, a
line for every statement, head and end of a block. Compared with the layout that the file has,
- an extreme expansion marks squeezed text, in whatever language,
- a canonical text that is the same block over and over, but for names and numbers, was written by a tool,
- a file in which literals outweigh everything else carries data.
Notices in comments, at any place of the text, and the place and name of the file are evidence of their own: the problem
is stated by them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .codelex import LANGUAGE, STRETCH, STRING, language_of

# Segments of directories and forms of names.
GENERATED_DIRS = ("gen", "generated", "__generated__", "_generated", "autogen", "autogenerated", "auto_generated", "generated-sources", "build")
VENDOR_DIRS = ("vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "extern", "external", "externals", "deps", "node_modules", "bower_components", "jspm_packages", "site-packages", "godeps", "pods", "carthage")
GENERATED_NAME = r"[._](?:generated|gen|g|pb|pb2|pb2_grpc|pbjson|designer|autogen|auto)\.[a-z]+$|(?:^|/)zz_generated[._]"
MINIFIED_NAME = r"[._-]min\.(?:js|mjs|cjs|css|ts)$"

#: Where a notice begins: a line, sentence or clause of a comment, with the file as its subject if it has one.
_LEAD = r"(?:^\W*|[.:;|(!–—]\s*[\"'(*<]?|\s-+\s+)(?:(?:this|the) (?:file|source|code|module|class|script|document|header)s? (?:is|was|has been) (?:an? )?|this (?:is|was) (?:an? )?)?"
#: Notices of a tool, wherever in a file they stand: told by their form, so that a remark on ids that are generated is none.
TOOL_NOTICE = re.compile(
    rf"{_LEAD}@?generated\b(?<=@generated)|<auto-?generated|{_LEAD}(?:auto-?|automatically |machine[- ])generated\b(?=\W*$|\s*[.:;,|(!–—*-]| (?:by|from|with|using|on|at|via|file|code|source|module|class|document|content|header|stub|binding)s?\b)(?! (?:types|code|files|schema) (?:by|are|is|should|must))(?! by (?:the |a |an )?(?:database|db|server|backend|caller|user|default)\b)"
    rf"|{_LEAD}code generated by\b|\bgenerated (?:automatically )?(?:by|from|with|using) (?:the )?[\w./-]+[^\n]{{0,80}}?(?:do not (?:edit|modify|change)|overwritten|lost|at the next build|regenerate)"
    rf"|(?:{_LEAD}|, *|please )do not (?:edit|modify)\b(?=\W*$|\s*[.;:!,(–—-]| (?:this |the )?(?:file|source|module)\b| (?:this|it)?\W*$| (?:it |this )?(?:by hand|manually|directly)\b)|{_LEAD}(?:created|written|produced|emitted) (?:automatically )?by (?:the )?[\w.-]*(?:gen|generator|compiler|codegen|protoc)\b|{_LEAD}(?:created|written|produced) automatically by\b"
    rf"|\bmanual changes (?:to this file )?(?:will be|are) (?:lost|overwritten)\b|(?:{_LEAD}|, *)(?:(?:any|all|your|local) )?changes (?:will be|are) (?:lost|overwritten)\b|\bchanges (?:made )?to this file (?:will be|are) (?:lost|overwritten)\b|;\s*hands off\b",
    re.I | re.M,
)
#: A comment that speaks about generated or vendored things instead.
ABOUT = re.compile(r"\b(?:todo|fixme|helpers? for|wraps?|decides|replace|checks?|tests? for|edit freely|handles?|reads?|parses?|finds?|detects?|which|our own)\b", re.I)
#: Notices of foreign origin, release and licence, told by their form too.
FOREIGN_NOTICE = re.compile(
    rf"{_LEAD}third[- ]party copy of\b|{_LEAD}vendored from\b|{_LEAD}(?:copied|imported|taken|ported|forked) (?:verbatim )?from [^\n]{{1,60}}\b(?:version|release|upstream|v?\d+\.\d+)|{_LEAD}upstream project\b(?=:| [\w./-]+\W*(?:$|[);,]))"
    r"|@license\b[^\n]*\d+\.\d+|^\W*[\w.@/-]+ v?\d+\.\d+(?:\.\d+)*\b[^\n]{0,80}(?:\(c\)|copyright|licen[cs]ed?\b|released under)|\breleased under the [^\n]{1,40}licen[cs]e by\b|^\W*[\w.@/-]+ v?\d+\.\d+(?:\.\d+)* *\|[^\n]*\blicensed?\b",
    re.I | re.M,
)

_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"(?<![\w.])-?\d[\w.]*")
_IMPORT = re.compile(r"^\s*(?:(?:import|export|from|require|require_relative|use)\b[^\n]*\x01|[\w\s.=,{}*]*\brequire\(\x01\)|\x01$|\}\s*from\s*\x01)", re.M)


_ROUND = re.compile(r"\([^(){}]*\)")
_CUT = re.compile(r"([;{}])")
_SPACES = re.compile(r"\s+")
#: Languages whose statements and blocks end with marks; in the others lines do it.
_MARKED = ("typescript", "javascript", "go", "java", "rust", "cpp")


def canonical(code: str, language: str) -> list[tuple[int, str]]:
    """The code, lexed, as its canonical layout: (depth, text) of each line, one statement, head of a block or end of a block
    a line, blanks folded. Round brackets stay together."""
    if language not in _MARKED:
        rows = [x for x in code.split("\n") if x.strip()]
        return [(len(x) - len(x.lstrip()), _SPACES.sub(" ", x.strip())) for x in rows]
    while True:
        n = _ROUND.sub(lambda m: "\x02" + m[0][1:-1].replace(";", ",") + "\x03", code)
        if n == code:
            break
        code = n
    out: list[tuple[int, str]] = []
    depth = 0
    for line in code.split("\n"):
        if not line or line.isspace():
            continue
        parts = _CUT.split(line)
        for text, end in zip(parts[::2], [*parts[1::2], ""]):
            text = _SPACES.sub(" ", text.strip())
            if end == "}":
                if text:
                    out.append((depth, text))
                depth = max(0, depth - 1)
                out.append((depth, "}"))
            elif text or end == "{":
                out.append((depth, text + end))
                depth += end == "{"
            elif end == ";" and out:
                out[-1] = (out[-1][0], out[-1][1] + ";")
    return out


def _repeated(lines: list[tuple[int, str]]) -> tuple[float, int]:
    """(share, number) of the blocks of the most frequent shape, by lines, among all lines: blocks of several lines that
    begin at one depth, at the depth where it is most. A shape has words and numbers alike."""
    best = (0.0, 0)
    shapes = [(d, _WORD.sub("w", _NUMBER.sub("0", x))) for d, x in lines]
    for level in sorted({d for d, _ in shapes})[:2]:
        blocks: dict[tuple[str, ...], int] = {}
        block: list[str] = []
        for d, x in shapes:
            if d == level and not x.startswith("}"):
                if len(block) > 2:
                    blocks[tuple(block)] = blocks.get(tuple(block), 0) + 1
                block = []
            if d >= level:
                block.append(x)
        if len(block) > 2:
            blocks[tuple(block)] = blocks.get(tuple(block), 0) + 1
        if blocks:
            shape, n = max(blocks.items(), key=lambda b: len(b[0]) * b[1])
            best = max(best, (len(shape) * n / len(shapes), n))
    return best


def measures(text: str, language: str) -> dict[str, float | str]:
    """The layout of a text against its canonical one. expansion: lines of the canonical layout per line that is there;
    longest and mean line; uniformity: share of lines in blocks of one shape, and blocks: how many; literal: share of the
    characters that are literals (with what separates them); comment: all comments."""
    comments, strings = [], 0

    def mark(m: re.Match) -> str:
        nonlocal strings
        if m[1] is not None:
            comments.append(m[1])
            return "\n" if "\n" in m[1] else " "
        strings += len(m[0])
        before = m.groupdict().get("before")
        return (before or "") + STRING

    code = STRETCH[language].sub(mark, text)
    lines = [x for x in map(str.strip, code.split("\n")) if x]
    if not lines:
        return {"expansion": 0.0, "longest": 0.0, "mean": 0.0, "uniformity": 0.0, "blocks": 0, "literal": 0.0, "lines": 0, "comment": "\n".join(comments)}
    size = sum(map(len, lines)) + strings
    numbers = sum(map(len, _NUMBER.findall(code)))
    n = len(lines)
    layout = canonical(code, language)
    uniformity, blocks = _repeated(layout) if len(layout) >= UNIFORM_LINES else (0.0, 0)
    separators = code.count(",") + code.count(STRING)
    return {
        "expansion": len(layout) / n,
        "longest": float(max(map(len, lines))),
        "mean": size / n,
        "uniformity": uniformity,
        "blocks": blocks,
        # The names in imports are no data.
        "literal": 0.0 if 2 * len(_IMPORT.findall(code)) > n and "[" not in code else min(1.0, (strings + numbers + separators) / max(1, size)),
        "lines": n,
        "comment": "\n".join(comments),
    }


#: Squeezed: the canonical layout has this many times the lines, and lines are this long in the mean or at the longest.
SQUEEZED, SQUEEZED_MEAN, SQUEEZED_LONGEST = 5.0, 110, 400
#: Written by a tool: this share of the canonical lines are blocks of one shape, at least so many lines and blocks of it.
UNIFORM, UNIFORM_LINES, UNIFORM_BLOCKS = 0.9, 60, 20


#: A file carries only data if literals and what separates them make up this share of it, from this size on.
DATA_SHARE, DATA_LEAST = 0.8, 200
KINDS = ("generated", "vendored", "minified", "data")


def _below(names: tuple[str, ...]) -> str:
    return "(?:^|/)(?:" + "|".join(names) + ")/"


#: What the place and name of a file (with slashes) say, whatever its letters' case.
PLACES = {"generated": f"(?i)(?:{GENERATED_NAME}|{_below(GENERATED_DIRS)})", "vendored": f"(?i){_below(VENDOR_DIRS)}", "minified": f"(?i){MINIFIED_NAME}"}
_PLACES = {k: re.compile(p) for k, p in PLACES.items()}


def text_kinds(text: str | None, language: str | None) -> list[str]:
    """What a text says of itself: by its layout against the canonical one, and by notices in its comments."""
    if not text or not language:
        return []
    m = measures(text, language)
    notes = [x for x in map(str.strip, m["comment"].split("\n")) if x]
    out = []
    if m["uniformity"] >= UNIFORM and m["blocks"] >= UNIFORM_BLOCKS or any(TOOL_NOTICE.search(x) and not ABOUT.search(x) for x in notes):
        out.append("generated")
    if any(FOREIGN_NOTICE.search(x) and not ABOUT.search(x) for x in notes):
        out.append("vendored")
    if m["expansion"] >= SQUEEZED and (m["mean"] >= SQUEEZED_MEAN or m["longest"] >= SQUEEZED_LONGEST):
        out.append("minified")
    if m["literal"] >= DATA_SHARE and len(text) >= DATA_LEAST:
        out.append("data")
    return out


def kinds(path: str, text: str | None) -> list[str]:
    """Kinds of one file that is not hand-written source, in the order of KINDS; empty for any other."""
    p = (path or "").replace("\\", "/")
    told = text_kinds(text, language_of(p))
    return [k for k in KINDS if k in told or k in _PLACES and _PLACES[k].search(p)]


def classify(files: DataFrame, inputs: DataFrame) -> DataFrame:
    """file_id, path, language, kinds (array) of every file with any kind: current rows of files with their texts.

    files: id, path, relative_path; inputs: path, content. Names are judged below the project (relative_path). A file
    without a text, or with a null or empty one, is judged by its place alone; one without a path not at all. Copies of
    an input row count once; differing texts of a path count together. Texts are read whole, where they are: they are not
    moved, only what is found in them is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_kinds(t, language_of(p)) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            some = [i for i, k in enumerate(got) if k]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int32())), pa.array([got[i] for i in some], pa.list_(pa.string()))], ["path", "told"])

    texts = spread(inputs.where(F.col("path").isNotNull() & (F.length("content") > 0)).select("path", "content")).mapInArrow(run, "path string, told array<string>")
    told = texts.select("path", F.explode("told").alias("k")).groupBy("path").agg(F.collect_set("k").alias("told"))
    rel = F.coalesce("relative_path", "path")
    j = files.where(F.col("path").isNotNull()).select(F.col("id").cast("bigint").alias("file_id"), rel.alias("rel"), "path").join(told, "path", "left")
    placed = F.translate("rel", "\\", "/")
    is_told = lambda k: F.coalesce(F.array_contains("told", k), F.lit(False))
    every = F.array_compact(F.array(*[F.when(is_told(k) | (placed.rlike(PLACES[k]) if k in PLACES else F.lit(False)), k) for k in KINDS]))
    language = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv]), F.lower(F.substring_index("rel", ".", -1)))
    return j.select("file_id", F.col("rel").alias("path"), language.alias("language"), every.alias("kinds")).where(F.size("kinds") > 0)
