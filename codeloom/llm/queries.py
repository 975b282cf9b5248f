"""Queries of the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import current_files, table
from . import leaks, neighbours, packing, provenance, residue, syntax

registry = Registry()
q = registry.add


# 8: no real content
@q("p8_found")
def p8_found(spark, d):
    return residue.evidence(table(spark, d, "documents")).select("doc_id").distinct()


@q("p8_evidence")
def p8_evidence(spark, d):
    return residue.evidence(table(spark, d, "documents"))


@q("p8_kept_by_source")
def p8_kept_by_source(spark, d):
    docs = table(spark, d, "documents")
    bad = residue.evidence(docs).select("doc_id", F.lit(1).alias("bad")).distinct()
    j = docs.select("doc_id", "source").join(bad, "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("docs"), F.count("bad").alias("excluded"))


# 7: leaked test items
def _leaks(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@q("p7_found")
def p7_found(spark, d):
    return _leaks(spark, d)


@q("p7_items")
def p7_items(spark, d):
    return _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc_id"))


@q("p7_suites")
def p7_suites(spark, d):
    items = table(spark, d, "eval_items").select("item_id", "suite").distinct()
    hit = _leaks(spark, d).select("item_id").distinct().withColumn("hit", F.lit(1))
    return items.join(hit, "item_id", "left").groupBy("suite").agg(F.count("*").alias("items"), F.count("hit").alias("leaked"))


# 1: most similar vectors
def _similar(spark, d):
    return neighbours.similar(current_files(table(spark, d, "files"), "embedding"), dim=96)


@q("p1_found")
def p1_found(spark, d):
    return _similar(spark, d).select(F.least("id", "neighbour").alias("file_a"), F.greatest("id", "neighbour").alias("file_b")).distinct()


@q("p1_neighbours")
def p1_neighbours(spark, d):
    return _similar(spark, d)


# 6: packing
@q("p6_containers")
def p6_containers(spark, d):
    return packing.pack(table(spark, d, "documents"))


@q("p6_summary")
def p6_summary(spark, d):
    p = packing.pack(table(spark, d, "documents")).where("container is not null")
    bins = p.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.max("unused").alias("unused"))
    return bins.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused"), F.ceil(F.sum("tokens") / packing.CAPACITY).alias("lower_bound"))


# 5: not hand-written
def _classified(spark, d):
    return provenance.classify(current_files(table(spark, d, "files"), "path", "relative_path"), table(spark, d, "code_inputs"))


@q("p5_found")
def p5_found(spark, d):
    return _classified(spark, d).select("file_id").distinct()


@q("p5_kinds")
def p5_kinds(spark, d):
    return _classified(spark, d).select("file_id", "language", F.array_join("kinds", ",").alias("kinds"))


@q("p5_by_language")
def p5_by_language(spark, d):
    return _classified(spark, d).select("language", F.explode("kinds").alias("kind")).groupBy("language", "kind").agg(F.count("*").alias("files"))


# 2: files that do not parse
def _checked(spark, d):
    return syntax.check(current_files(table(spark, d, "files"), "project_id", "path"), table(spark, d, "code_inputs"))


@q("p2_found")
def p2_found(spark, d):
    return _checked(spark, d).where("broken").select("file_id").distinct()


@q("p2_files")
def p2_files(spark, d):
    return _checked(spark, d)


@q("p2_rates")
def p2_rates(spark, d):
    return syntax.rates(_checked(spark, d))
