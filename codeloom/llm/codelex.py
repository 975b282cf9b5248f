"""What the operators on source texts share: languages by extension, and one pattern a language for the stretches in
which brackets and words mean nothing (comments, strings, characters, templates, regular expressions)."""

from __future__ import annotations

import re

#: Extension -> language of the file (fixed values of the task).
LANGUAGE = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "java": "java",
    "rs": "rust", "rb": "ruby", "rake": "ruby", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "h": "cpp",
}

_LINE, _BLOCK, _HASH = r"//[^\n]*", r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/", r"#[^\n]*"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`(?:[^`\\]|\\[\s\S])*`|\{(?:[^{}`]|\{[^{}`]*\}|`(?:[^`\\]|\\[\s\S])*`)*\})*\})*`"
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_JS_BEFORE = r"(?:[=(,:;!&|?{}\[+*%~^]|=>|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|await|yield))[ \t\r\n]*"

#: comment | string; other alternatives that open a stretch without closing it are `open`.
_PARTS = {
    "javascript": (rf"{_BLOCK}|{_LINE}", rf"{_DQ}|{_SQ}|{_TEMPLATE}", r"/\*|[\"'`]"),
    "go": (rf"{_BLOCK}|{_LINE}", rf"{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[^\n])[^'\n]{{0,10}}'", r"/\*|[\"'`]"),
    "java": (rf"{_BLOCK}|{_LINE}", rf'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|{_DQ}|{_SQ}', r"/\*|[\"']"),
    "rust": (rf"{_BLOCK}|{_LINE}", r'b?r(#{1,4})"[\s\S]*?"\2|b?r"[^"]*"|b?"(?:[^"\\]|\\[\s\S])*"' + r"|b?'(?:[^'\\\n]|\\(?:[^\nu]|u\{[0-9a-fA-F_]*\}|x[0-9a-fA-F]{2}))'", r"/\*|\""),
    "cpp": (rf"{_BLOCK}|{_LINE}", rf'(?:u8|[uUL])?R"([^()\\\s]{{0,16}})\([\s\S]*?\)\2"|{_DQ}|(?<![0-9a-fA-F]){_SQ}', r"/\*|\"|(?<![0-9a-fA-F])'"),
    "ruby": (r"(?m:^=begin\b[\s\S]*?^=end\b[^\n]*)|(?<![\w$])#(?!\{)[^\n]*|(?<=\w)[ \t]#[^\n]*", r'"(?:[^"\\#]|\\[\s\S]|#(?!\{)|#\{[^{}]*\})*"' + r"|'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|%[wWiIqQr]?(?:\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\})", r"[\"'`]"),
    "python": (_HASH, r'[rbufRBUF]{0,2}"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + r"[rbufRBUF]{0,2}'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''" + rf"|[rbuf]{{0,2}}{_DQ}|[rbuf]{{0,2}}{_SQ}", r"[\"']"),
}
STRETCH = {k: re.compile(rf"({c})|{s}") if k not in ("rust", "cpp") else re.compile(rf"({c})|(?:{s})") for k, (c, s, _) in _PARTS.items()}
OPEN = {k: re.compile(o) for k, (_, _, o) in _PARTS.items()}
STRETCH["javascript"] = re.compile(rf"({_BLOCK}|{_LINE})|(?P<before>{_JS_BEFORE})(?P<regex>{_REGEX})|{_DQ}|{_SQ}|{_TEMPLATE}")
for _t in (STRETCH, OPEN):
    _t["typescript"] = _t["javascript"]

#: What stands for a string in blanked text: a character that no lexer knows.
STRING = "\x01"


def language_of(path: str) -> str | None:
    """The language that the extension of a path stands for."""
    return LANGUAGE.get(path.rpartition(".")[2].lower()) if path else None


def _blank(m: re.Match) -> str:
    if m[1] is not None:
        return "\n" if "\n" in m[1] else " "
    if "before" in m.re.groupindex and m["before"] is not None:
        return m["before"] + STRING
    return STRING + "\n" * m[0].count("\n") if "\n" in m[0] else STRING


def blank(text: str, language: str) -> str:
    """The text with each comment as white space and each string as STRING (line ends in it kept)."""
    return STRETCH[language].sub(_blank, text)
