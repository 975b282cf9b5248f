"""Small operators on texts: line differences, imports in order, answers of a reviewer, scaffolds, a reading path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_diff(pairs: DataFrame, before: str, after: str, key: str) -> DataFrame:
    """key, line_number, old, new of lines that differ at the same place; a line that only one text has is null in the other."""
    cut = lambda c: F.split(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\r\n?", "\n"), "\n")
    both = F.zip_with(cut(before), cut(after), lambda a, b: F.struct(a.alias("old"), b.alias("new")))
    x = pairs.select(key, F.posexplode(both).alias("pos", "d"))
    return x.where(~F.col("d.old").eqNullSafe(F.col("d.new"))).select(key, (F.col("pos") + 1).alias("line_number"), "d.old", "d.new")


def organize_imports(text: Column) -> Column:
    """The text with its one-line imports first, each once and in order, then an empty line and the rest. A text without
    imports stays as it is."""
    lines = F.split(text, "\n")
    imports = F.array_sort(F.array_distinct(F.filter(lines, lambda x: x.rlike(r"^import .*['\"];?\s*$"))))
    rest = F.ltrim(F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^import .*['\"];?\s*$")), "\n"), F.lit("\n"))
    return F.when(F.size(imports) > 0, F.concat_ws("\n\n", F.array_join(imports, "\n"), rest)).otherwise(text)


def parse_verdict(answer: Column) -> Column:
    """verdict (pass, warn, fail; warn if none is named), confidence (0.5 if none) and up to five suggestions of a
    reviewer's answer in the form VERDICT / CONFIDENCE / SUGGESTIONS."""
    verdict = F.lower(F.regexp_extract(answer, r"(?i)VERDICT:\s*(pass|warn|fail)", 1))
    sure = F.regexp_extract(answer, r"(?i)CONFIDENCE:\s*([0-9.]+)", 1).try_cast("double")
    tail = F.regexp_extract(answer, r"(?is)SUGGESTIONS:\s*(.*)$", 1)
    items = F.filter(F.transform(F.split(tail, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*]|\d+\.)\s*", ""))), lambda x: x != "")
    return F.struct(F.when(verdict == "", "warn").otherwise(verdict).alias("verdict"), F.coalesce(sure, F.lit(0.5)).alias("confidence"), F.slice(items, 1, 5).alias("suggestions"))


def scaffolds(symbols: DataFrame, key: str = "path") -> DataFrame:
    """key, docs, tests: a documentation outline and a test outline from exported symbols (key, kind, name)."""
    g = symbols.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("name", "kind"))).alias("s"))
    docs = F.concat(F.lit("# "), F.col(key), F.lit("\n\n"), F.array_join(F.transform("s", lambda x: F.concat(F.lit("## "), x["name"], F.lit(" ("), x["kind"], F.lit(")"))), "\n"))
    tests = F.array_join(F.transform("s", lambda x: F.concat(F.lit("it('"), x["name"], F.lit("', () => {});"))), "\n")
    return g.select(key, docs.alias("docs"), tests.alias("tests"))


def onboarding(files: DataFrame, role_words: list[str], n: int = 20) -> DataFrame:
    """The first n files (a reading list) for a role, by the number of its words in their paths, then by load."""
    hits = F.lit(0)
    for w in role_words:
        hits = hits + F.contains(F.lower("relative_path"), F.lit(w.lower())).cast("int")
    return files.select("id", "relative_path", hits.alias("hits"), F.coalesce("cognitive_load", F.lit(0.0)).alias("load")).where("hits > 0").orderBy(F.desc("hits"), F.desc("load"), "id").limit(n)


def minutes_of(label: Column) -> Column:
    """The first whole number of a label such as '30-45 min'; null without one."""
    return F.nullif(F.regexp_extract(label, r"(\d+)", 1), F.lit("")).try_cast("int")


def url_allowed(url: Column, hosts: list[str]) -> Column:
    """Whether a URL is https and of one of the hosts or below it; null is not allowed."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    fits = F.lit(False)
    for h in hosts:
        fits = fits | (host == h) | host.endswith("." + h)
    return F.coalesce(F.startswith(F.lower(url), F.lit("https://")) & fits, F.lit(False))


#: Hosts of the machine itself and of private networks.
PRIVATE_HOST = r"^(?:localhost|127\.0\.0\.1|\[?::1\]?|10\..*|172\.(?:1[6-9]|2[0-9]|3[01])\..*|192\.168\..*|169\.254\..*|\[?fd[0-9a-f]{2}:.*|\[?fe80:.*)$"


def private_url(url: Column) -> Column:
    """Whether a URL is of this machine or of a private network; null is not."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).rlike(PRIVATE_HOST), F.lit(False))


def major_upgrade(current: Column, wanted: Column) -> Column:
    """Whether the major version of wanted is above that of current; null if one has none."""
    major = lambda v: F.nullif(F.regexp_extract(v, r"^[\^~v]*(\d+)", 1), F.lit("")).try_cast("int")
    return major(wanted) > major(current)


def contract_cases(contracts: list[dict]) -> list[tuple[str, str, str, bool]]:
    """(contract, kind, example, is_violation) cases that a contract's own rules imply; a handful of settings."""
    out = []
    for c in contracts:
        out += [(c["id"], "forbidden", k, True) for k in c.get("forbidden", ())]
        out += [(c["id"], "required", k, False) for k in c.get("required", ())]
        if c.get("max_lines"):
            out.append((c["id"], "max_lines", "\n" * c["max_lines"], True))
    return out
