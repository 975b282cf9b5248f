"""Rules over the lines of source texts. Rule sets are a handful of settings, so they are compiled into the expression: no
join of rules with lines, one pass over the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex, keyword_match

# Rules of the line audit (name, severity, pattern).
AUDIT = (
    ("secret", "high", r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*[\"'][^\"']+[\"']"),
    ("aws-key", "critical", r"(?i)(aws[_-]?access[_-]?key|aws[_-]?secret[_-]?key)\s*[:=]\s*[\"'][^\"']+[\"']"),
    ("private-key", "critical", r"-----BEGIN (RSA|EC|DSA) PRIVATE KEY-----"),
    ("eval", "high", r"eval\s*\("),
    ("function-constructor", "high", r"new Function\s*\("),
    ("weak-crypto", "medium", r"crypto\.createCipher\(|crypto\.createDecipher\("),
    ("weak-hash", "medium", r"md5|sha1"),
)
# Where feature flags are read, line by line (framework, type, pattern with the name of the flag).
FLAGS = (
    ("unleash", "function", r"isEnabled\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("unleash", "function", r"getVariant\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("launchdarkly", "function", r"variation\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("launchdarkly", "function", r"boolVariation\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("custom", "config", r"(?:flags|features|toggles)\.(\w+)"),
    ("custom", "env", r"process\.env\.(\w+_ENABLED|\w+_FLAG)"),
    ("custom", "config", r"featureFlags\.(\w+)"),
    ("homegrown", "if", r"if\s*\(\s*['\"]([^'\"]+)['\"]\s*===?\s*['\"]true['\"]"),
    ("homegrown", "ternary", r"\w+\s*\?\s*.*\s*:\s*.*\s*\?\s*['\"]([^'\"]+)['\"]"),
)
# Exported symbols (kind, pattern with the name).
EXPORTS = (
    ("function", r"export\s+(?:async\s+)?function\s+(\w+)\s*\("),
    ("class", r"export\s+(?:abstract\s+)?class\s+(\w+)"),
    ("interface", r"export\s+interface\s+(\w+)"),
    ("type", r"export\s+type\s+(\w+)\s*="),
    ("const", r"export\s+const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::\s*[^=]+)?\s*=>"),
    ("enum", r"export\s+enum\s+(\w+)"),
)
# What counts as a test (the patterns overlap and are added up) and as an assertion.
TESTS = (r"(?:it|test)\s*\(\s*['\"`]", r"describe\s*\(\s*['\"`]", r"it\s*\(\s*['\"`]", r"it\(['\"`]")
ASSERTIONS = (r"expect\s*\(", r"assert\s*\.", r"should\s*\.", r"\.toBe\s*\(", r"\.toEqual\s*\(", r"\.toContain\s*\(", r"\.toHaveLength\s*\(")
# The default contracts.
DEFAULT_CONTRACTS = (
    {"id": "no-eval", "glob": "**/*.ts", "forbidden": [r"eval\s*\(", r"new\s+Function\s*\("], "severity": "error"},
    {"id": "no-raw-process-exit-in-core", "glob": "src/core/**/*.ts", "forbidden": ["process.exit("], "severity": "error"},
    {"id": "no-direct-db-in-mcp-tools", "glob": "src/mcp/tools/**/*.ts", "forbidden": ["CREATE TABLE", "DROP TABLE", "ALTER TABLE"], "severity": "warning"},
    {"id": "no-inline-any-in-cli", "glob": "src/cli/commands/**/*.ts", "forbidden": [r"\bany\b"], "severity": "error"},
    {"id": "no-hardcoded-paths-in-tools", "glob": "src/mcp/tools/**/*.ts", "forbidden": [r"\.\./\.\./src/storage"], "severity": "warning"},
    {"id": "no-unused-imports-in-critical", "glob": "src/core/**/*.ts", "forbidden_imports": ["src/cli/"], "severity": "error"},
)
# Sources and sinks of taint (callee, kind).
TAINT_SOURCES = (("fs.readFile", "FILE"), ("fs.readFileSync", "FILE"), ("fs.createReadStream", "FILE"), ("process.env", "ENV"), ("process.stdin", "STDIN"), ("fetch", "NETWORK"), ("http.request", "NETWORK"), ("https.request", "NETWORK"), ("net.connect", "SOCKET"))
TAINT_SINKS = (
    ("eval", "ENV"), ("Function", "ENV"), ("exec", "SOCKET"), ("execSync", "SOCKET"), ("execFile", "SOCKET"), ("spawn", "SOCKET"), ("child_process.exec", "SOCKET"), ("child_process.spawn", "SOCKET"),
    ("query", "DATABASE"), ("execute", "DATABASE"), ("send", "NETWORK"), ("write", "FILE"), ("writeFile", "FILE"), ("writeFileSync", "FILE"), ("createWriteStream", "FILE"),
)


def lines(texts: DataFrame, keep: list[str], text: str = "content") -> DataFrame:
    """keep, line_number (from 1), line. A null text has no lines, an empty one has one empty line."""
    return texts.where(F.col(text).isNotNull()).select(*keep, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("pos", "line")).select(*keep, (F.col("pos") + 1).alias("line_number"), "line")


def search_lines(texts: DataFrame, needle: str, limit: int = 20, key: str = "path") -> DataFrame:
    """The first `limit` lines, by key and number, that contain the needle (case aside), trimmed."""
    hit = texts.where(F.contains(F.lower("content"), F.lit(needle.lower())))
    return lines(hit, [key]).where(F.contains(F.lower("line"), F.lit(needle.lower()))).select(key, "line_number", F.trim("line").alias("line")).orderBy(key, "line_number").limit(limit)


def audit(texts: DataFrame, rules=AUDIT, key: str = "path") -> DataFrame:
    """key, line_number, rule, severity: one finding per line and rule. Texts that no rule fits are dropped before they
    are cut into lines."""
    anywhere = F.lit(False)
    for _, _, p in rules:
        anywhere = anywhere | F.col("content").rlike(p)
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, p in rules]))
    return lines(texts.where(anywhere), [key]).select(key, "line_number", F.explode(hits).alias("h")).select(key, "line_number", "h.rule", "h.severity")


def contracts(texts: DataFrame, rules: list[dict], key: str = "path", compat: bool = False) -> DataFrame:
    """key, contract, severity, kind, line_number of violations. A rule: id, glob, severity and any of forbidden
    (keywords), forbidden_imports, required (text that must be there), max_lines.

    One pass whatever the number of rules: what can be told of a text as a whole is worked out first, texts without any
    are dropped, and the lines of the rest are tried only for the rules that the text may break.
    """
    split = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    kind = lambda r, name: F.struct(F.lit(r["id"]).alias("contract"), F.lit(r.get("severity", "warning")).alias("severity"), F.lit(name).alias("kind"))
    whole: list[tuple[Column, Column]] = []  # condition of the text, what it breaks
    by_line: list[tuple[Column, Column, Column]] = []  # condition of the text, of the line, what the line breaks
    for r in rules:
        own = F.col(key).rlike(glob_regex(r["glob"], compat))
        for k in r.get("forbidden", ()):
            by_line.append((own & keyword_match(F.col("content"), k), keyword_match(F.col("line"), k), kind(r, "forbidden")))
        for k in r.get("forbidden_imports", ()):
            by_line.append((own & F.contains("content", F.lit(k)), F.contains("line", F.lit(k)) & F.col("line").rlike(r"import\b|require\s*\(|\bfrom\b"), kind(r, "forbidden_import")))
        for k in r.get("required", ()):
            whole.append((own & ~F.contains("content", F.lit(k)), kind(r, "required")))
        if r.get("max_lines"):
            whole.append((own & (F.size(split) > r["max_lines"]), kind(r, "max_lines")))
    none = F.array().cast("array<struct<contract:string,severity:string,kind:string>>")
    flags = F.array(*[c for c, _, _ in by_line]) if by_line else F.array().cast("array<boolean>")
    broken = F.array_compact(F.array(*[F.when(c, w) for c, w in whole])) if whole else none
    t = texts.where(F.col("content").isNotNull() & F.col(key).isNotNull()).select(key, "content", flags.alias("_may"), broken.alias("_broken"))
    t = t.where(F.exists("_may", lambda x: x) | (F.size("_broken") > 0))
    # The text as a whole stands before its lines, at place 0.
    lines_of = F.when(F.exists("_may", lambda x: x), split).otherwise(F.array().cast("array<string>"))
    x = t.select(key, "_may", "_broken", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), lines_of)).alias("pos", "line"))
    of_line = F.array_compact(F.array(*[F.when(F.col("_may")[n] & c, w) for n, (_, c, w) in enumerate(by_line)])) if by_line else none
    x = x.select(key, F.nullif("pos", F.lit(0)).alias("line_number"), F.explode(F.when(F.col("pos") == 0, F.col("_broken")).otherwise(of_line)).alias("v"))
    return x.select(key, "v.contract", "v.severity", "v.kind", "line_number")


def coherence(texts: DataFrame, violations: DataFrame, key: str = "path") -> DataFrame:
    """key, issues, verdict, confidence: quick rules on each text, with contract violations (errors weigh 3)."""
    v = violations.groupBy(key).agg(F.sum(F.when(F.col("severity") == "error", 3).otherwise(1)).alias("weight"), F.bool_or(F.col("severity") == "error").alias("failed"))
    n = F.size(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n"))
    count = lambda p: F.regexp_count("content", F.lit(p))
    anys = F.size(F.filter(F.split("content", "[^A-Za-z0-9_]+"), lambda w: w == "any"))
    slashed = F.translate(F.col(key), "\\", "/")
    tool = F.contains(slashed, F.lit("/cli/commands/")) | F.contains(slashed, F.lit("/scripts/")) | F.contains(slashed, F.lit("/tests/"))
    own = F.when(n > 400, 1).otherwise(0) + F.when(count(r"(?m)^import ") > 20, 1).otherwise(0) + F.when(anys > 5, 1).otherwise(0) + F.when((count(r"console\.\w+") > 3) & ~tool, 1).otherwise(0)
    j = texts.where(F.col("content").isNotNull()).select(key, own.alias("own")).join(v, key, "left")
    issues = (F.col("own") + F.coalesce("weight", F.lit(0))).cast("bigint")
    verdict = F.when(F.coalesce("failed", F.lit(False)) | (issues > 2), "fail").when(issues == 0, "pass").otherwise("warn")
    return j.select(key, issues.alias("issues"), verdict.alias("verdict"), F.round(F.greatest(F.lit(0.3), F.lit(0.9) - issues * 0.15), 4).alias("confidence"))


def extract(texts: DataFrame, families, key: str, name: str, kind: str) -> DataFrame:
    """key, kind, name for all matches of a family of patterns."""

    def named(k: str, p: str) -> Column:
        return F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), lambda x: F.struct(F.lit(k).alias("k"), x.alias("n")))

    found = F.concat(*[named(k, p) for k, p in families])
    return texts.where(F.col("content").isNotNull()).select(key, F.explode(found).alias("f")).select(key, F.col("f.k").alias(kind), F.col("f.n").alias(name))


def feature_flags(texts: DataFrame, key: str = "path") -> DataFrame:
    """key, line_number, framework, type, flag, default_on of flags read in a line. Texts and lines without any are
    dropped before the patterns run; the ternary one runs only on lines that have its last part."""
    some = r"isEnabled|getVariant|ariation|flags\.|features\.|toggles\.|_ENABLED|_FLAG|featureFlags|if\s*\(\s*['\"]|\?\s*['\"]"

    def named(framework: str, kind: str, p: str) -> Column:
        found = F.regexp_extract_all("line", F.lit(p), F.lit(1))
        if kind == "ternary":
            found = F.when(F.col("line").rlike(r"\?\s*['\"][^'\"]+['\"]"), found).otherwise(F.array().cast("array<string>"))
        return F.transform(found, lambda x: F.struct(F.lit(framework).alias("framework"), F.lit(kind).alias("type"), x.alias("flag")))

    rows = lines(texts.where(F.col("content").rlike(some)), [key]).where(F.col("line").rlike(some))
    on = F.contains("line", F.lit("true")) | F.contains("line", F.lit("enabled"))
    return rows.select(key, "line_number", on.alias("default_on"), F.explode(F.concat(*[named(*f) for f in FLAGS])).alias("f")).select(key, "line_number", "f.framework", "f.type", "f.flag", "default_on")


def taint(texts: DataFrame, key: str = "path") -> DataFrame:
    """key, variable, source, source_kind, sink, sink_kind: variables set from a source of outside data that are handed,
    bare, to a sink in the same text. Names hold for the whole file; values are not followed from one to another."""
    name = lambda n: n.replace(".", r"\.")
    sources = "|".join(name(n) for n, _ in sorted(TAINT_SOURCES, key=lambda x: -len(x[0])))
    sinks = "|".join(name(n) for n, _ in sorted(TAINT_SINKS, key=lambda x: -len(x[0])))
    get, put = rf"\b(?:const|let|var)\s+(\w+)(?:\s*:[^=;]+)?\s*=\s*({sources})\b(?!\.)", rf"(?<![\w.])({sinks})\s*\(([^()]*)\)"
    all_of = lambda p, i: F.regexp_extract_all("content", F.lit(p), F.lit(i))
    t = texts.where(F.col("content").rlike(get)).select(key, F.arrays_zip(all_of(get, 1).alias("v"), all_of(get, 2).alias("s")).alias("from_"), F.arrays_zip(all_of(put, 1).alias("k"), all_of(put, 2).alias("a")).alias("to_"))
    r = t.select(key, "to_", F.explode("from_").alias("f")).select(key, "f", F.explode("to_").alias("t"))
    kind = lambda c, table: F.element_at(F.create_map(*[F.lit(x) for kv in table for x in kv]), c)
    args = F.transform(F.split("t.a", ","), lambda x: F.trim(x))
    return r.where(F.array_contains(args, F.col("f.v"))).select(key, F.col("f.v").alias("variable"), F.col("f.s").alias("source"), kind(F.col("f.s"), TAINT_SOURCES).alias("source_kind"), F.col("t.k").alias("sink"), kind(F.col("t.k"), TAINT_SINKS).alias("sink_kind"))


def api_surface(texts: DataFrame, key: str = "path") -> DataFrame:
    return extract(texts, EXPORTS, key, "name", "kind")


def api_diff(base: DataFrame, now: DataFrame, keys: list[str], signature: str) -> DataFrame:
    """keys, change (added, removed, changed), breaking. Unchanged symbols do not come out."""
    a = base.select(*keys, F.col(signature).alias("_a"), F.lit(True).alias("_ia"))
    b = now.select(*keys, F.col(signature).alias("_b"), F.lit(True).alias("_ib"))
    j = a.join(b, keys, "full_outer")
    change = F.when(F.col("_ia").isNull(), "added").when(F.col("_ib").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(*keys, change.alias("change")).where("change is not null").withColumn("breaking", F.col("change") != "added")


def unused_imports(texts: DataFrame, key: str = "path") -> DataFrame:
    """key, name of default or star imports whose name stands nowhere else in the text."""
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^import (?:\* as )?([A-Za-z_$][A-Za-z0-9_$]*) from"), F.lit(1)))
    words = F.split("content", "[^A-Za-z0-9_$]+")
    once = F.filter("names", lambda n: F.size(F.filter("words", lambda w: w == n)) < 2)
    return texts.where(F.col("content").isNotNull()).select(key, names.alias("names"), words.alias("words")).where(F.size("names") > 0).select(key, F.explode(once).alias("name"))


def test_quality(texts: DataFrame, key: str = "path") -> DataFrame:
    """Per test file: tests, assertions, and whether it is weak (fewer than 1.5 assertions a test)."""
    t = texts.where(F.col("content").isNotNull() & (F.contains(key, F.lit(".test.")) | F.contains(key, F.lit(".spec.")) | F.contains(key, F.lit("/tests/"))))
    total = lambda ps: sum((F.regexp_count("content", F.lit(p)) for p in ps[1:]), F.regexp_count("content", F.lit(ps[0])))
    tests, checks = total(TESTS), total(ASSERTIONS)
    return t.select(key, tests.cast("bigint").alias("tests"), checks.cast("bigint").alias("assertions")).withColumn("weak", (F.col("tests") > 0) & (F.col("assertions") < F.col("tests") * 1.5))


#: Words of a text by which its framework is told, the first that it has; and those of the kind of test.
FRAMEWORKS = (("jest", ("jest",)), ("playwright", ("playwright",)), ("cypress", ("cypress",)), ("mocha", ("mocha",)))
KINDS = (("e2e", ("e2e", "playwright", "cypress")), ("integration", ("integration", ".int.")), ("component", ("component",)))


def is_test(path: Column) -> Column:
    return F.contains(path, F.lit(".test.")) | F.contains(path, F.lit(".spec.")) | F.contains(path, F.lit("/tests/"))


def test_kinds(texts: DataFrame, key: str = "path") -> DataFrame:
    """key, framework (vitest if none is told), type (unit if none is told) of test files."""

    def first(table, other: str) -> Column:
        out = F.lit(other)
        for name, words in reversed(table):
            fits = F.lit(False)
            for w in words:
                fits = fits | F.contains("content", F.lit(w))
            out = F.when(fits, name).otherwise(out)
        return out

    return texts.where(F.col("content").isNotNull() & is_test(F.col(key))).select(key, first(FRAMEWORKS, "vitest").alias("framework"), first(KINDS, "unit").alias("type"))


def doc_tags(texts: DataFrame, key: str = "path") -> DataFrame:
    """key, since, deprecated, doc_length of the first documentation comment of each text that has one."""
    doc = texts.select(key, F.regexp_extract("content", r"/\*\*([\s\S]*?)\*/", 1).alias("doc")).where(F.col("doc") != "")
    return doc.select(key, F.nullif(F.regexp_extract("doc", r"@since\s+(\S+)", 1), F.lit("")).alias("since"), F.contains("doc", F.lit("@deprecated")).alias("deprecated"), F.length("doc").cast("bigint").alias("doc_length"))


def config_flags(texts: DataFrame, key: str = "path") -> DataFrame:
    """key, flag, default_on of objects with a field `enabled` in files whose names speak of configuration or flags."""
    p = r"(\w+)\s*:\s*\{[\s\S]*?enabled\s*:\s*(true|false)"
    of = lambda n: F.regexp_extract_all("content", F.lit(p), F.lit(n))
    named = F.contains(key, F.lit("config")) | F.contains(key, F.lit("flag")) | F.contains(key, F.lit("feature"))
    t = texts.where(named & F.contains("content", F.lit("enabled"))).select(key, F.explode(F.arrays_zip(of(1).alias("n"), of(2).alias("v"))).alias("f"))
    return t.select(key, F.col("f.n").alias("flag"), (F.col("f.v") == "true").alias("default_on"))


def docs(texts: DataFrame, key: str = "path") -> DataFrame:
    """key, title: the first line of the first block comment of each text that has one."""
    title = F.trim(F.regexp_extract("content", r"/\*+[ \t]*\n?[ \t]*\*?[ \t]*([^*\n]+)", 1))
    return texts.select(key, title.alias("title")).where(F.col("title") != "")


def flag_references(flags: DataFrame, texts: DataFrame, key: str = "path") -> DataFrame:
    """flag, texts, refs: in how many texts each name stands as a word, and how often: words are counted, map-side first, and
    meet names in an equi-join when they are a row each."""
    words = texts.where(F.col("content").isNotNull()).select(key, F.explode(F.split("content", "[^A-Za-z0-9_]+")).alias("flag")).groupBy("flag", key).agg(F.count("*").alias("n"))
    counts = words.groupBy("flag").agg(F.count(key).alias("texts"), F.sum("n").alias("refs"))
    return flags.select("flag").distinct().join(counts, "flag", "left").select("flag", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("texts", "refs")))
