"""Scalar functions as Columns; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> language of the scanner (fixed values).
SCAN_LANGUAGE = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go",
    "rs": "rust", "java": "java", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp", "rb": "ruby",
}


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity, unlike round()."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in SCAN_LANGUAGE.items() for v in kv]), ext), F.lit("unknown"))


def rolling_hash32(text: Column) -> Column:
    """h = 31 h + c over the characters, in 32 bits, as the unsigned magnitude of the signed value. Characters count as
    code points; outside the basic plane that differs from UTF-16 units."""
    units = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(F.filter(units, lambda u: u > 0), F.lit(0).cast("bigint"), lambda a, u: (a * 31 + u).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.abs(F.when(h >= 2**31, h - 2**32).otherwise(h))


def rolling_hash_hex(text: Column) -> Column:
    return F.lower(F.hex(rolling_hash32(text)))


def naming_convention(name: Column) -> Column:
    """The first of camel, Pascal, snake and SCREAMING case that a name fits, else unknown."""
    return (
        F.when(name.rlike("^[a-z][a-zA-Z0-9]*$"), "camelCase")
        .when(name.rlike("^[A-Z][a-zA-Z0-9]*$"), "PascalCase")
        .when(name.rlike("^[a-z][a-z0-9_]*$"), "snake_case")
        .when(name.rlike("^[A-Z][A-Z0-9_]*$"), "SCREAMING_SNAKE")
        .otherwise("unknown")
    )


def cognitive_load(complexity: Column, imports: Column, functions: Column) -> Column:
    return (complexity * 0.5 + imports * 0.3 + functions * 0.2) / 100


def token_estimate(size: Column) -> Column:
    return F.ceil(size / 4)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def genome_label(score: Column) -> Column:
    return F.when(score >= 0.9, "Excellent").when(score >= 0.75, "Good").when(score >= 0.6, "Fair").otherwise("Poor")


def slug(text: Column, mark: str = "_") -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9]", mark)


def plain_version(version: Column) -> Column:
    return F.regexp_replace(version, r"^[\^~]+", "")


def major(version: Column) -> Column:
    return F.split(plain_version(version), r"\.")[0].try_cast("int")


def json_or_text(value: Column) -> Column:
    """A value that is JSON as VARIANT, any other as a VARIANT string."""
    return F.coalesce(F.try_parse_json(value), F.to_variant_object(F.struct(value.alias("text"))))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def glob_regex(glob: str, compat: bool = False) -> str:
    """A path glob as a regular expression. `**/` stands for any number of directories, `*` for part of a name.

    compat: `*` and `**/*.ts` match every path, and the star inside `**` is narrowed again so that it stands for exactly
    one directory, as rule sets written for that behaviour expect.
    """
    if compat:
        if glob in ("*", "**/*.ts"):
            return "(?s)^.*$"
        g = "".join("\\" + c if c in ".+^${}()|[]\\" else c for c in glob)
        return "(?i)^" + g.replace("**", ".*").replace("*", "[^/]*").replace("?", ".") + "$"
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append("\\" + glob[i] if glob[i] in ".+^${}()|[]\\" else glob[i])
            i += 1
    return "(?i)^" + "".join(out) + "$"


def layer_glob_regex(glob: str) -> str:
    """A glob of a layer as a regular expression, as sets of layers expect it: case counts, a dot is any character, and the
    star within `**` is narrowed again, so that it stands for one directory."""
    return "^" + glob.replace("**", ".*").replace("*", "[^/]*").replace("?", ".") + "$"


def percent(share: Column, digits: int = 1) -> Column:
    """A share as text, for reports."""
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))


def keyword_match(text: Column, keyword: str) -> Column:
    """A keyword with regular-expression characters that compiles is one (case aside); any other is plain text."""
    import re

    if re.search(r"[\\^$.*+?()\[\]{}|]", keyword):
        try:
            re.compile(keyword)
            return text.rlike("(?i)" + keyword)
        except re.error:
            pass
    return F.contains(text, F.lit(keyword))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 if one is null or empty, lengths differ, or a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok, F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))).otherwise(F.lit(0.0))
