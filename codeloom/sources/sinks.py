"""Reports to files, by Spark's own writers; texts of reports are built as one row by expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import xml_escape


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def markdown_table(df: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """One row, text: all rows, or the first `limit` of them, as a Markdown table in the order given."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    rows = (df.orderBy(*order).limit(limit) if limit else df).select(F.struct(*order).alias("o"), cells.alias("line"))
    return rows.agg(F.concat_ws("\n", F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n")).alias("text"))


def html_table(df: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """One row, text: all rows, or the first `limit` of them, as an HTML table in the order given."""
    cell = lambda c: F.concat(F.lit("<td>"), xml_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    rows = (df.orderBy(*order).limit(limit) if limit else df).select(F.struct(*order).alias("o"), F.concat(F.lit("<tr>"), *[cell(c) for c in df.columns], F.lit("</tr>")).alias("line"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n")
    return rows.agg(F.concat(F.lit(f"<table>\n{head}\n"), body, F.lit("\n</table>")).alias("text"))


def d3_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, text: {"nodes": [...], "links": [...]} of a module graph (nodes: module; edges: a, b, links)."""
    n = nodes.select("module").distinct().agg(F.sort_array(F.collect_list(F.struct(F.col("module").alias("id")))).alias("nodes"))
    e = edges.agg(F.sort_array(F.collect_list(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), F.col("links").alias("value")))).alias("links"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "links")).alias("text"))


def sbom(packages: DataFrame, style: str, name: str) -> DataFrame:
    """One row, text: a bill of materials of packages (package, version, kind) in the style spdx, cyclonedx or json."""
    p = packages.select("package", "version", "kind").distinct()
    if style == "spdx":
        block = F.concat(F.lit("PackageName: "), "package", F.lit("\nSPDXID: SPDXRef-Package-"), F.regexp_replace("package", "[^a-zA-Z0-9]", "-"), F.lit("\nPackageVersion: "), "version", F.lit("\nPackageDownloadLocation: NOASSERTION"))
        head = f"SPDXVersion: SPDX-2.3\nDataLicense: CC0-1.0\nSPDXID: SPDXRef-DOCUMENT\nDocumentName: {name}\n"
        return p.select(block.alias("b")).agg(F.concat_ws("\n", F.lit(head), F.array_join(F.sort_array(F.collect_list("b")), "\n\n")).alias("text"))
    if style == "cyclonedx":
        c = F.struct(F.lit("library").alias("type"), F.col("package").alias("name"), "version", F.concat(F.lit("pkg:npm/"), "package", F.lit("@"), "version").alias("purl"))
        return p.agg(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.sort_array(F.collect_list(c)).alias("components"))).alias("text"))
    return p.agg(F.to_json(F.struct(F.lit(name).alias("name"), F.sort_array(F.collect_list(F.struct("package", "version", "kind"))).alias("packages"))).alias("text"))


def sbom_valid(text: str, style: str) -> bool:
    """Whether a bill of materials has the marks of its style (fixed values)."""
    need = {"spdx": ("SPDXVersion:", "DataLicense:", "PackageName:"), "cyclonedx": ("CycloneDX", "specVersion", "components"), "json": ("packages",)}
    return all(x in text for x in need[style])
