"""Source files that do not parse.

A text is cut into chunks at line ends at which its lexer is in code, so a comment, string or template is never cut and
each chunk is lexed as it would be within the whole. A chunk is summarised: the state it leaves (code, unless something is
never closed), the brackets it closes and opens that have no partner inside it, and its code with comments and strings
taken out. Summaries compose, (a + b) + c = a + (b + c), so chunks of one file may lie in any partition; a file of one
chunk needs no shuffle at all. What is balanced is then parsed: brackets are folded from the inside out, what stands in
each is tried against the local rules of its language (which operators, separators and operands may meet), and the
statements of the top level are matched with a local grammar. Balanced pieces of Python texts go to the interpreter's own
grammar at that point.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .codelex import OPEN, STRETCH, STRING, blank, language_of

#: Characters of a chunk.
CHUNK = 32_768

#: States that run over line ends, and what ends them.
STATES = {
    "javascript": {"/*": r"\*/", "`": r"(?<!\\)(?:\\\\)*`"}, "typescript": {"/*": r"\*/", "`": r"(?<!\\)(?:\\\\)*`"}, "go": {"/*": r"\*/", "`": "`"},
    "java": {"/*": r"\*/", '"""': r'(?<!\\)"""'}, "rust": {"/*": r"\*/", '"': r'(?<!\\)(?:\\\\)*"'}, "cpp": {"/*": r"\*/"},
    "ruby": {'"': r'(?<!\\)(?:\\\\)*"', "'": r"(?<!\\)(?:\\\\)*'", "`": r"(?<!\\)(?:\\\\)*`"}, "python": {},
}

_PAIRS = {")": "(", "]": "[", "}": "{"}
_NO_BRACKET = re.compile(r"[^()\[\]{}]+")
_CONFLICT = re.compile(r"^(?:<{7}|>{7}|={7}|\|{7})(?:[ \t\r]|$)", re.M)
_QUOTES = re.compile("[“”„‘’«»…–—·•]")
_HEREDOC = re.compile(r"<<[~-]?(['\"`]?)([A-Za-z_]\w*)\1([^\n]*)\n[\s\S]*?^[ \t]*\2[ \t]*$", re.M)
_DEFINE = re.compile(r"^[ \t]*#[ \t]*define\b(?:\\\n|[^\n])*", re.M)
_JSX_TAG = r"<(?:/?[A-Za-z][\w.:-]*(?:\s+[\w:-]+(?:=(?:\"[^\"]*\"|'[^']*'|\{(?:[^{}]|\{[^{}]*\})*\}))?)*\s*/?)?>"
_JSX_TEXT = re.compile(rf"({_JSX_TAG})([^<>{{}}=;()]*?)(?=[<{{])")
_JSX_AFTER = re.compile(r"\}([^<>{}=;()\n]*)(?=</[A-Za-z>])")
JSX = ("javascript", "typescript")


def prepare(text: str, language: str) -> str:
    """Without byte-order mark and carriage returns; texts between tags and heredocs are taken out, for quotes in them
    are no quotes."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if language in JSX and "</" in text:
        text = _JSX_AFTER.sub("}", _JSX_TEXT.sub(r"\1", text))
    elif language == "cpp" and "define" in text:
        text = _DEFINE.sub("#define", text)  # what a macro stands for need not be balanced
    elif language == "ruby" and "<<" in text:
        text = _HEREDOC.sub(lambda m: STRING + m[3], text)
    return text


# ---------------------------------------------------------------- chunks


def reduce_brackets(code: str) -> tuple[str, str, bool]:
    """Brackets without a partner: those that close something before, those that stay open; whether a pair mismatches."""
    b = _NO_BRACKET.sub("", code)
    while True:
        n = b.replace("()", "").replace("[]", "").replace("{}", "")
        if len(n) == len(b):
            break
        b = n
    opened = 0
    while opened < len(b) and b[opened] in ")]}":
        opened += 1
    closers, rest = b[:opened], b[opened:]
    return closers, rest, any(c in ")]}" for c in rest)


def summarise(chunk: str, state: str, language: str) -> tuple[str, str, str, bool, str]:
    """(state left, closers, openers, error, code) of a chunk that is entered in a state ("" for code)."""
    if state:
        m = re.compile(STATES[language][state]).search(chunk)
        if not m:
            return state, "", "", False, "\n" * chunk.count("\n")
        chunk = (STRING if state != "/*" else " ") + chunk[m.end() :]
    code = blank(chunk, language)
    left, error = "", False
    if m := OPEN[language].search(code):
        for s in STATES[language]:
            if code.startswith(s, m.start()):
                left, code = s, code[: m.start()] + (STRING if s != "/*" else " ")
                break
        else:
            error = True
    closers, openers, bad = reduce_brackets(code)
    return left, closers, openers, error or bad, code


def compose(a: tuple[str, str, str, bool, str], b: tuple[str, str, str, bool, str]) -> tuple[str, str, str, bool, str]:
    """The summary of two neighbouring chunks, b entered in the state that a leaves. Associative."""
    k = min(len(a[2]), len(b[1]))
    bad = any(o != _PAIRS[c] for o, c in zip(reversed(a[2]), b[1][:k]))
    return b[0], a[1] + b[1][k:], a[2][: len(a[2]) - k] + b[2], a[3] or b[3] or bad, a[4] + b[4]


def cut_chunks(text: str, language: str, size: int = CHUNK) -> list[str]:
    """The text in chunks of at least size characters, each but the last ending with the first line end after them that
    lies in no comment, string or template."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    stretches = STRETCH[language].finditer(text)
    m = next(stretches, None)
    while at < len(text):
        end = text.find("\n", at + size - 1)
        while end >= 0:
            while m and m.end() <= end + 1:
                m = next(stretches, None)
            if not m or m.start() > end:
                break
            end = text.find("\n", m.end() - 1)
        end = len(text) if end < 0 else end + 1
        out.append(text[at:end])
        at = end
    return out


# ---------------------------------------------------------------- local grammars

# After folding: \x02 stands for (...), \x03 for [...], \x04 for {...}.
_P, _B, _C = "\x02", "\x03", "\x04"
_INNER = re.compile(r"\(([^()\[\]{}]*)\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
_MARK = {"(": _P, "[": _B, "{": _C}


# What may not stand in a bracket, whatever the statement: the order of operators, separators and operands is the same in
# all of these languages but for a few. Fixed values by language; each is a piece of a pattern.
_BRACED = ("typescript", "javascript", "go", "java", "rust", "cpp")
#: Operators that need something on both sides.
_BETWEEN = {
    **dict.fromkeys(("typescript", "javascript"), r"===|!==|==|!=|<=(?!>)|>=|[-+*/%]=|\|\||&&|\?\?"), "go": r":=|==|!=|<=|>=|[-+*/%]=|\|\||&&", "java": r"==|!=|<=|>=|[-+*/%]=|\|\||&&",
    "rust": r"==|!=|<=|>=|[-+*/%]=", "cpp": r"==|!=|<=(?!>)|>=|[-+/%]=|\|\|",
}
#: The same, with the plain assignment (which is no part of an arrow or of another operator).
_SET = r"(?<![-+*/%=!<>&|^~:?])=(?![=>~])"
#: Operators after which something has to follow.
_OPEN_END = {**dict.fromkeys(("typescript", "javascript"), r"=>|(?<![+*])\+(?!\+)|(?<!-)-(?!-)|%"), "go": r"(?<!\+)\+(?!\+)|%", "java": r"(?<!\+)\+(?!\+)|(?<!-)-(?!-)|%|->", "rust": r"\+(?!=)|%|=>", "cpp": r"%"}
#: Words that no name or value can be set with.
_NO_NAME = {**dict.fromkeys(("typescript", "javascript"), "const|var"), "go": "var|const|func|return|if|for|switch", "java": "return|if|while|for|switch|new|class|throw|final|int|long|double|boolean|char", "rust": "let|const|static|fn|return|if|while|match", "cpp": "return|if|while|for|switch|int|double|bool|char|class|struct"}
#: Words that go on after a number on its line.
_AFTER_NUMBER = {**dict.fromkeys(("typescript", "javascript"), "as|in|of|instanceof|satisfies|else|if|is|extends|from|while"), "go": "", "java": "instanceof|else|extends|super", "rust": "as|if|else|in|where", "cpp": "and|or|xor|not_eq|bitand|bitor|else"}
#: Words that begin a statement, so that the statement before them must have ended, where a semicolon ends one.
_NEXT = {"java": "return|for|while|try|throw|switch|break|continue|if", "rust": "let|return|for|while|loop|use", "cpp": "return|for|while|switch|break|continue|throw|if"}


def _rules(language: str) -> tuple[dict[str, re.Pattern], ...]:
    """By kind of bracket, the pattern of what may not stand in it."""
    both = rf"(?:{_BETWEEN[language]}|{_SET})"
    end = rf"(?:{_BETWEEN[language]}|{_SET}|{_OPEN_END[language]})"
    tight = rf"(?>{_BETWEEN[language]}|{_SET})[ \t\n]*(?:{_BETWEEN[language]}|=(?![=>])|%)" if language not in ("cpp",) else rf"(?>{_BETWEEN[language]}|{_SET})[ \t\n]+(?:{_BETWEEN[language]}|=(?![=>])|%)"
    word = rf"(?<![\w.$#@&]){{0}}[ \t]*(?:{_BETWEEN[language]}|=(?![=>]))".format(f"(?:{_NO_NAME[language]})")
    after = f"(?!(?:{_AFTER_NUMBER[language]})\\b)" if _AFTER_NUMBER[language] else ""
    number = rf"(?<![\w.$\x01-\x04])\d[\w.]*[ \t]+{after}(?:[A-Za-z_]\w*(?![\w]*\x01)|\d)"
    anywhere = [tight, word, number]
    if language != "cpp":
        anywhere.append(r"\x01[ \t]*\x01" if language != "go" else r"\x01[ \t]+\x01")
    if language in ("typescript", "javascript", "java", "rust"):
        anywhere.append(r"(?<!:):[ \t]*=(?![=>])")
    round_ = [rf"^\s*,|,\s*,|^\s*{both}|,\s*{both}|{end}\s*(?:$|[,;])"]
    curly = [rf"{end}[ \t]*[;,]", rf"^\s*{both}", rf";\s*{both}"]
    if language in ("go", "java", "cpp"):  # no block is a value there
        anywhere.append(rf"(?:==|!=|<=|>=|&&|\|\|{'|:=' if language == 'go' else ''})[ \t]*\x04" if language != "cpp" else r"(?:==|!=|\|\|)[ \t]*\x04")
    square = [r"^\s*,\s*,"] if language in ("typescript", "javascript") else [r"^\s*,|,\s*,"]
    if language in ("java", "cpp"):
        round_.append(r",\s*$")
    if language == "rust":
        words = "mut|ref|dyn|impl|as|in|if|let|else|move|const|unsafe|where|for|return|box|async|await|match|loop|while|break|pub|fn|static|extern|crate|type|use"
        round_.append(rf"(?<![\w'$.:#!])(?!(?:{words})\b)[a-z_]\w*[ \t]+(?!(?:{words})\b)[a-z_]\w*\b(?![!:])")
    if language in _NEXT:
        curly.append(rf"(?<![\w@#$])(?!(?:else|do|return|static|final|public|private|protected|inline|unsafe|async|default|try|virtual|constexpr|const|case|in)\b)[A-Za-z_]\w*(?:[ \t]*[\x02\x03])?[ \t]*=[ \t]*(?:[\w.]+|\x01)[ \t]*\n[ \t]*(?:{_NEXT[language]})\b")
    make = lambda parts: re.compile("|".join(f"(?:{x})" for x in [*parts, *anywhere]))
    return {"(": make(round_), "[": make(square), "{": make(curly), "": make([rf"{end}[ \t]*;"])}


_RULES = {k: _rules(k) for k in _BRACED}
_ANNOTATION = re.compile(r"@[\w.]+\s*\Z")


def brackets_parse(code: str, language: str) -> str | None:
    """The top level with each bracket folded, if what stands in every bracket, from the inside out, keeps to the local
    rules of the language; None if some bracket does not."""
    rules = _RULES[language]
    ok = True

    def one(m: re.Match) -> str:
        nonlocal ok
        text = m[0]
        if len(text) > 2 and (rules[text[0]].search(text[1:-1]) or language == "java" and text[0] == "(" and text[1:-1].strip() == _C and not _ANNOTATION.search(m.string, max(0, m.start() - 200), m.start())):
            ok = False
        return _MARK[text[0]]

    while True:
        n = _INNER.sub(one, code)
        if not ok:
            return None
        if n == code:
            return None if rules[""].search(code) else code
        code = n


_GO = re.compile(
    rf"""\s*package[ \t]+\w+[ \t]*(?=[;\n]|$)(?:[\s;]*(?:
      import\s*(?:{_P}|(?:[\w.]+[ \t]+)?{STRING}) |
      func[ \t]*(?:{_P}[ \t]*)?\w+[ \t]*(?:{_B})?{_P}[^\n{_C}]*(?:{_C}(?:[ \t]*{_C})?)? |
      type[ \t]*(?:{_P}|\w+[ \t]*(?:{_B})?[ \t]*[^\n;]*[\w{_P}{_B}{_C}]) |
      (?:var|const)[ \t]*(?:{_P}|\w+(?:[ \t]*,[ \t]*\w+)*[ \t]*(?:[^\n;=]*=[ \t]*[^;]*?[\w{STRING}{_P}{_B}{_C}]|[\w.*{_B}][^\n;=]*))
    )[ \t]*(?=[;\n]|$))*[\s;]*""",
    re.X,
)
_JAVA = re.compile(
    rf"""[\s;]*(?:(?:@[\w.]+\s*{_P}?\s*)*package\s+\w+(?:\s*\.\s*\w+)*\s*;)?[\s;]*(?:import\s+(?:static\s+)?\w+(?:\s*\.\s*\w+)*(?:\s*\.\s*\*)?\s*;[\s;]*)*
    (?:(?:@(?!interface\b)[\w.]+\s*{_P}?\s*|(?:public|protected|private|abstract|final|static|strictfp|sealed|non-sealed)\s+)*
       (?:(?:class|interface|enum|@interface)\s+\w+[^;{_C}{_P}=]*{_C}|record\s+\w+[^;{_C}{_P}]*{_P}[^;{_C}]*{_C})[\s;]*)*""",
    re.X,
)
_RUST = re.compile(
    rf"""\s*(?:\#![^\n\[{_B}]*\n)?(?:\s*(?:\#!?\s*{_B}\s*)*(?:pub\s*(?:{_P}\s*)?)?(?:
      use\b[^;]*; | mod\s+\w+\s*(?:;|{_C}) | (?:const|static)\s+(?:mut\s+)?\w+\s*:[^;=]+=[^;]+; | type\s+\w+[^;]*; |
      (?:(?:default|const|async|unsafe|extern(?:\s*{STRING})?)\s+)*fn\s+\w+[^;{_C}{_P}]*{_P}[^;{_C}]*(?:{_C}|;) |
      (?:struct|union)\s+\w+[^;{_C}{_P}]*(?:{_P}[^;{_C}]*;|;|{_C}) | enum\s+\w+[^;{_C}]*{_C} | (?:unsafe\s+|auto\s+)*(?:impl|trait)\b[^;{_C}]*{_C} |
      (?:unsafe\s+)?extern\s*(?:{STRING}\s*)?{_C} | extern\s+crate\s+\w+[^;]*; | macro_rules!\s*\w+\s*[{_P}{_B}{_C}]\s*;? | \w+(?:::\w+)*!\s*\w*\s*(?:{_C}|[{_P}{_B}]\s*;)
    ))*\s*(?:\#!\s*{_B}\s*)*""",
    re.X,
)
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)(?:\\\n|[^\n])*", re.M)
_DIRECTIVES = {"", "include", "include_next", "define", "undef", "if", "ifdef", "ifndef", "elif", "elifdef", "elifndef", "else", "endif", "pragma", "error", "warning", "line", "import", "embed"}
_CPP_ITEM = re.compile(rf"\s*(?:(?:public|protected|private)\s*:(?!:)\s*)?([^;{_C}]*?)\s*(;|{_C}(?:\s*(?:;|{_C}))?)")
_CPP_ALIEN = re.compile(r"(?:package|def|fn|pub|func|function|export\s+(?!template|module)|let|var|public|private|protected|end|impl|from|require|interface|import\s+\w+\s+(?:from|as))\b|use\s+\w+::|const\s+\w+\s*=|[^\w~:\[(\x02\x03@*&!]|\w+\s*:\s*\x04")
_CPP_HEAD = re.compile(r"(?:namespace|class|struct|union|enum|extern|template|inline|static|constexpr|using|typedef|concept|requires|module|export|asm|__\w+)\b")

_JS_KEYWORDS = "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch throw try typeof var void while with as implements let static yield of from async await get set readonly declare namespace module abstract keyof unique infer is asserts satisfies type interface public private protected override accessor out global require using"
_JS_FIRST = "|".join(_JS_KEYWORDS.replace(" require", "").split())
_JS_SECOND = r"as|in|of|is|from|instanceof|extends|implements|satisfies|if|while|else|catch|finally|infer|asserts|keyof"
#: Two names side by side, of which none is a word of the language.
_JS_ADJACENT = re.compile(rf"(?<![\w$.#@\x02</])(?!(?:{_JS_FIRST})\b)[A-Za-z_$][\w$]*[ \t]+(?!(?:{_JS_SECOND})\b)(?:[A-Za-z_$]|\x01|\d)")
_JS_ALIEN = re.compile(r"^\s*(?:#(?!!)|<!|from\s+[\w.]+\s+import\b|import\s+[\w.]+\s*(?:;|$|\n|as\b)|import\s+static\b|\{\s*\x01\s*:|using\s+namespace\b|static\s+\w+\s+\w+\s*[=\[]|public\s|private\s)", re.M)
#: What only TypeScript has.
_TYPES = re.compile(
    r"^[ \t]*(?:export[ \t]+)?(?:declare[ \t]+|const[ \t]+(?=enum))*(?:interface[ \t]+[\w$]+[^\n;=(]*\{|type[ \t]+[\w$]+[^\n;(]*=|enum[ \t]+[\w$]+[ \t]*\{|namespace[ \t]+[\w$.]+[ \t]*\{|abstract[ \t]+class\b)|\(\s*(?:\.\.\.)?[\w$]+\??\s*:|\b(?:const|let|var)\s+[\w$]+\s*:"
    r"|[\w$)\]\x01][ \t]+as[ \t]+(?:unknown|any|const|string|number|boolean|never|object)\b|\bfunction\b[ \t]*\*?[ \t]*[\w$]*[ \t]*(?:<[^<>(]*>)?\([^()]*\)\s*:\s*[\w{(\[]|\)\s*:\s*[\w.<>\[\]| ]+=>|^[ \t]*(?:public|private|protected|readonly)[ \t]+[\w$]+\s*[:(=;]|\bimport\s+type\b(?!\s*(?:from|,))|\bexport\s+type\b",
    re.M,
)
_JS_TAIL_END = re.compile(rf"(?:(?<![+-])[+-]|[=*%&|^,.<?:~!]|=>|(?<![>\w{_P}{_B}{STRING}])>|\b(?:const|let|var|import|export|function|class|interface|extends|implements|new|typeof|default|async|await|enum|case|throw|delete|void|instanceof|else|try|do|finally))\s*$")
_JS_TAIL = re.compile(
    rf"""(?:import\s*(?:{STRING}|{_P}.*|(?:type\s+)?[\w$*{_C},\s]+\s+from\s*{STRING}|type\s*{_C}\s*from\s*{STRING}|{_C}\s*from\s*{STRING}|[\w$]+\s*=\s*.+)(?:\s*with\s*{_C})? |
      export\s*(?:\*(?:\s*as\s+[\w$]+)?\s*from\s*{STRING}|(?:type\s+)?{_C}(?:\s*from\s*{STRING})?|default\s+(?!function\b|class\b|async\b|abstract\b).+|=\s*.+|as\s+namespace\s+\w+|(?:declare\s+)?(?:const|let|var)\s+.+|type\s+[\w$]+.*=.+|import\s+.+|declare\s+.+) |
      (?:declare\s+)?const\s+[\w${_B}{_C}]+[^=]*=.+ | (?:declare\s+)?(?:let|var)\s+[\w${_B}{_C}].* | type\s+[\w$]+[^=]*=.+ | declare\s+(?:function|global|module|namespace)\b.* |
      (?:if|while|for|with)\s*(?:await\s*)?{_P}.+ | (?:return|break|continue|debugger|throw)\b.* |
      (?!(?:import|export|const|let|var|function|class|interface|enum|namespace|abstract|declare|if|while|for|switch|try|catch|else|do)\b(?!\s*[.=(]))[^\n]*(?:\n.*)*)""",
    re.X | re.S,
)
_JS_OPEN_FROM = re.compile(r"(?:^|[\n;])[ \t]*(?:import|export)\b[^\n;]*\bfrom[ \t]*(?:\n[ \t]*(?!\x01)\S|;|\Z)")
_JS_HEAD_NO_BODY = re.compile(r"(?:^|[\n;\x04])[ \t]*(?:export[ \t]+(?:default[ \t]+)?)?(?:async[ \t]+)?(?:function\b[ \t]*\*?[ \t]*[\w$]*|class[ \t]+[\w$]+[^\x04;\n=]*|interface[ \t]+[\w$]+[^\x04;\n=]*|enum[ \t]+[\w$]+)[ \t]*(?=\n[ \t]*(?:export|import|const|let|var|function|class)\b|\Z)")

_RUBY_OPEN = re.compile(r"(?:^|;|(?<=[=(|&,]))[ \t]*(?:(?:private|public|protected|module_function|private_class_method)[ \t]+(?=def\b))?(?:\w+[ \t]*(?:\|\|)?=[ \t]*)?(def|class|module|begin|case|if|unless|while|until|for)\b(?![?!:]|[ \t]*=[^=~>])", re.M)
_RUBY_DO = re.compile(r"(?<![.\w@:$])do\b(?![?!:])")
_RUBY_END = re.compile(r"(?<![.\w@:$])end\b(?![?!:\w])")
_RUBY_LOOP = re.compile(r"(?:^|;)[ \t]*(?:while|until|for)\b[^\n;]*?\bdo\b", re.M)
_RUBY_ENDLESS = re.compile(r"^[ \t]*def[ \t]+[\w.?!]+[ \t]*(?:\([^()]*\))?[ \t]+=(?![=~>])", re.M)
_RUBY_ALIEN = re.compile(
    r"^[ \t]*(?:(?:def|if|elif|while|for|else|try|except|with|class)\b[^\n]*:[ \t]*$|(?:func|fn|pub|function|export|let|var|int|void|static|import|from|const|using|#include|elif|except)\b[ \t]+[\w{\x01*]|public[ \t]+(?:class|static|final|int|void)\b|package[ \t]+[\w.]+;?[ \t]*$|\}[ \t]*else\b|<[!/a-zA-Z])|[\w)\x02\x03]\s*;\s*\n\s*\}|\bint\b[ \t]+\w+[ \t]*[=,)]|=>\s*\{\s*\n|^[ \t]*-[ \t]+\w+[ \t]+\w+[ \t]+\w+[^\n]*$",
    re.M,
)
_RUBY_TOGETHER = re.compile(r",[ \t]*,|(?:==|!=|<=|>=|&&)[ \t]+(?:==|!=|<=|>=|&&|\|\||=(?![=~>]))|(?<![=!<>*+\-/|&%^~?:.\]])=[ \t]+(?:==?|&&|\|\|)[ \t]|(?:==|!=|<=|>=|&&)[ \t]*\)")
_RUBY_TAIL = re.compile(r"(?:[=+*%&|^,.<:~(\[{]|(?<!\w)-|\b(?:def|class|module|and|or|not|unless|if|while|until|elsif|when|in))\s*\Z")


def _cpp(code: str, top: str) -> bool:
    words = {m[1] for m in _DIRECTIVE.finditer(code)}
    if words - _DIRECTIVES:
        return False
    code = top.replace(_C + ",", _C + ";") if "#" in code else top
    at, end, block = 0, len(code.rstrip()), False
    while at < end:
        m = _CPP_ITEM.match(code, at)
        if not m or m.end() == at:
            return False
        head = m[1].strip()
        if head and _CPP_ALIEN.match(head):
            return False
        if m[2][0] == _C:
            if not head or not ("=" in head or _P in head or _CPP_HEAD.match(head) or re.match(r"[\w:<>,*&\s]+$", head)):
                return False
            if _P not in head and "=" not in head and not re.search(r"\b(?:namespace|class|struct|union|enum|extern|concept|requires)\b", head) and not re.match(r"(?:[\w:<>,*&]+\s+)+[\w:]+(?:\s*\x03)*$", head):
                return False
            if _P in head and re.search(r"\x02\s*:\s*$|->\s*$", head):
                return False
        elif head and not block and re.match(r"[A-Za-z_]\w*$", head):
            return False
        at, block = m.end(), m[2] == _C
    return True


def _ruby(code: str) -> bool:
    # Only what precedes __END__ is code.
    code = re.split(r"^__END__$", code, maxsplit=1, flags=re.M)[0]
    flat = fold_round(code)
    if _RUBY_ALIEN.search(flat) or _RUBY_TAIL.search(flat) or _RUBY_TOGETHER.search(code):
        return False
    depth = 0
    events = [(m.start(1), 1) for m in _RUBY_OPEN.finditer(code)] + [(m.start(), 1) for m in _RUBY_DO.finditer(code)] + [(m.start(), -1) for m in _RUBY_END.finditer(code)]
    events += [(m.end(), -1) for m in _RUBY_LOOP.finditer(code)] + [(m.end(), -1) for m in _RUBY_ENDLESS.finditer(code)]
    for _, d in sorted(events):
        depth += d
        if depth < 0:
            return False
    return depth == 0


_ROUND = re.compile(r"\([^()]*\)")


def fold_round(code: str) -> str:
    """Round brackets alone folded, line ends kept."""
    return _ROUND.sub(lambda m: _P + "\n" * m[0].count("\n"), code)


def _js(code: str, top: str) -> bool:
    if m := _JS_ALIEN.search(code):
        line = code[code.rfind("\n", 0, m.end() - 1) + 1 :]
        if not m[0].strip().startswith("{") or not code[: m.start()].strip():
            if not re.match(r"\s*(?:public|private|static)\b", m[0]) or code.count("{", 0, m.start()) == code.count("}", 0, m.start()):
                if not (m[0].strip().startswith("#") and re.match(r"\s*#[A-Za-z_$][\w$]*\s*[=;(:!?]", line)):
                    return False
    if _JS_ADJACENT.search(code):
        return False
    if _JS_HEAD_NO_BODY.search(top) or _JS_OPEN_FROM.search(top):
        return False
    tail = re.split(rf"[;{_C}](?=\s)|\n(?=[ \t]*\n)", top.rstrip() + "\n")[-1].strip()
    # The last statement, from its own line on: lines before it end by themselves.
    lines = [x for x in tail.split("\n") if x.strip()]
    if not lines:
        return not re.search(r"(?:=>|=|\bextends|\bfrom)\s*\Z", top)
    if _JS_TAIL_END.search(lines[-1]):
        return False
    return bool(_JS_TAIL.fullmatch(lines[-1].strip())) or len(lines) > 1 and bool(_JS_TAIL.fullmatch(tail))


_PY_TOP = re.compile(r"^(?!(?:else|elif|except|finally)\b)[^\s#)\]}]", re.M)


def python_parses(text: str, chunk: int = CHUNK) -> bool:
    """Whether a text is Python: its brackets balance, and each of its pieces is a sequence of statements to the interpreter's
    own grammar. Pieces end where a statement of the top level begins, so each is parsed by itself. Where the brackets do
    not balance (or seem not to, as in some strings within strings) the grammar is asked about the text as a whole."""
    text = text.removeprefix("\ufeff")
    if len(text) <= chunk:
        return _python(text)
    code = blank(text.replace("\r\n", "\n").replace("\r", "\n"), "python")
    closers, openers, bad = reduce_brackets(code)
    if closers or openers or bad or OPEN["python"].search(code):
        return _python(text)
    lines, code_lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), code.split("\n")
    if len(lines) != len(code_lines):
        return _python(text)
    pieces, begin, size, depth, joined = [], 0, 0, 0, False
    for n, (line, bare) in enumerate(zip(lines, code_lines)):
        if size >= chunk and depth == 0 and not joined and _PY_TOP.match(bare):
            pieces.append("\n".join(lines[begin:n]) + "\n")
            begin, size = n, 0
        size += len(line) + 1
        depth += sum(map(bare.count, "([{")) - sum(map(bare.count, ")]}"))
        joined = bare.rstrip().endswith("\\") or bare.startswith("@")
    pieces.append("\n".join(lines[begin:]))
    return all(map(_python, pieces))


def _python(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError):
        return True


def statements_parse(code: str, language: str) -> bool:
    """Whether balanced code (comments and strings taken out) is a sequence of statements of its language."""
    if not code.strip():
        return True
    if _CONFLICT.search(code) or _QUOTES.search(code):
        return False
    if language == "ruby":
        return _ruby(code)
    # A backslash goes on with a line; what a directive says is no code.
    top = brackets_parse(_DIRECTIVE.sub("", code) if language == "cpp" else code, language)
    if top is None:
        return False
    if language == "go":
        return bool(_GO.fullmatch(top))
    if language == "java":
        return bool(_JAVA.fullmatch(top))
    if language == "rust":
        return bool(_RUST.fullmatch(top))
    if language == "cpp":
        return _cpp(code, top)
    return _js(code, top) and not (language == "javascript" and _TYPES.search(code))


def parses(text: str, language: str, chunk: int = CHUNK) -> bool:
    """Whether a text is a file of its language; an empty one is."""
    if language == "python":
        return python_parses(text, chunk)
    total = ("", "", "", False, "")
    for part in cut_chunks(prepare(text, language), language, chunk):
        total = compose(total, summarise(part, "", language))
        if total[0] or total[3] or total[1]:  # what is open at a cut is never closed
            return False
    return not total[2] and statements_parse(total[4], language)


# ---------------------------------------------------------------- on tables

_PIECES = "path string, language string, n int, state string, closers string, openers string, error boolean, code string"
#: Summaries of a file that one task puts together; the results of those go on in the same way.
FAN = 16


def verdicts(inputs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """path, language, broken of every text whose extension stands for a known language; inputs: path, content.

    Texts are parsed where they are read and never moved: only their verdicts are. Chunks of long ones are summarised
    wherever they land; summaries are composed FAN neighbours at a time, and the last composition is parsed.
    """
    texts = spread(inputs.where(F.col("path").isNotNull() & F.col("content").isNotNull()).select("path", "content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                language = language_of(path)
                if language == "python" or language and len(text) <= chunk:
                    rows.append((path, language, not parses(text, language, chunk), None))
                elif language:
                    rows.append((path, language, None, cut_chunks(prepare(text, language), language, chunk)))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())))], ["path", "language", "broken", "chunks"])

    first = cut(texts.mapInArrow(run, "path string, language string, broken boolean, chunks array<string>"))
    short = first.where("broken is not null").select("path", "language", "broken")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, lang, n, *summarise(text, "", lang)) for f, lang, n, text in zip(*(b.column(i).to_pylist() for i in range(4)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()])], [x.split()[0] for x in _PIECES.split(", ")])

    def together(t: pa.Table) -> tuple[dict, tuple[str, str, str, bool, str]]:
        rows = t.sort_by([("n", "ascending")]).to_pylist()
        by = {r["n"]: (r["state"], r["closers"], r["openers"], r["error"] or r["state"] != "", r["code"]) for r in rows}
        total = ("", "", "", False, "")
        for n in sorted(by):
            total = compose(total, by[n])
        return rows[0], total

    def neighbours(t: pa.Table) -> pa.Table:
        row, (state, closers, openers, error, code) = together(t)
        return pa.table({"path": [row["path"]], "language": [row["language"]], "n": pa.array([row["n"] // FAN], pa.int32()), "state": [state], "closers": [closers], "openers": [openers], "error": [error], "code": [code]})

    def verdict(t: pa.Table) -> pa.Table:
        row, (_, closers, openers, error, code) = together(t)
        return pa.table({"path": [row["path"]], "language": [row["language"]], "broken": [error or closers != "" or openers != "" or not statements_parse(code, row["language"])]})

    # Copies of a long text are summarised once.
    apart = first.where("chunks is not null").dropDuplicates(["path"]).select("path", "language", F.posexplode("chunks").alias("n", "text"))
    parts = apart.repartition("path", "n").mapInArrow(pieces, _PIECES)
    parts = parts.groupBy("path", F.floor(F.col("n") / FAN).alias("part")).applyInArrow(neighbours, _PIECES)
    return short.unionByName(parts.groupBy("path").applyInArrow(verdict, "path string, language string, broken boolean"))


def check(files: DataFrame, inputs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """file_id, project_id, language, broken: every file with a text whose extension stands for a known language.

    files: id, project_id, path (current rows); inputs: path, content. Null contents are no texts, empty ones are valid.
    Copies of an input row count once; of differing texts of a path any broken one makes the file broken.
    """
    v = verdicts(inputs, chunk).groupBy("path").agg(F.max("language").alias("language"), F.max("broken").alias("broken"))
    return files.where(F.col("path").isNotNull()).select(F.col("id").cast("bigint").alias("file_id"), F.col("project_id").cast("bigint").alias("project_id"), "path").join(v, "path").drop("path").select("file_id", "project_id", "language", "broken")


def rates(checked: DataFrame) -> DataFrame:
    """project_id, language, files, broken, rate: per project and language, per project (language null) and per language
    (project_id null)."""
    g = checked.groupingSets([["project_id", "language"], ["project_id"], ["language"]], "project_id", "language")
    return g.agg(F.count("*").alias("files"), F.count_if("broken").alias("broken"), F.round(F.count_if("broken") / F.count("*"), 6).alias("rate"))
