"""Source trees as tables, without driver-side walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import language_of

# Suffixes that are scanned, and directories that are not.
SCANNED = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "java", "rb", "php", "c", "cpp", "h", "hpp")
IGNORED = ("node_modules", "dist", "dist-tests", ".git", ".next", ".turbo", "coverage", ".cache", "tmp", "temp", ".vscode", ".idea", "build", "out", "target", "__pycache__", ".venv", "venv", "vendor")
IGNORED_NAMES = (r"\.min\.[^/]*$", r"\.map$", r"\.d\.ts$", r"(?:^|/)package-lock\.json$", r"(?:^|/)yarn\.lock$")


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path, relative_path, language, size_bytes, hash, modified, content of the source files below root.

    Reads by the binaryFile source: the listing and the bytes are distributed, and without content only the listing is
    read. Bytes that are no UTF-8 are replaced.
    """
    base = root.rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SCANNED) + "}").load(base)
    path = F.regexp_replace("path", "^file:(?://)?", "")
    rel = F.substr(path, F.lit(len(base) + 2))
    skip = "(?:^|/)(?:" + "|".join(x.replace(".", r"\.") for x in IGNORED) + ")/"
    out = f.select(path.alias("path"), rel.alias("relative_path"), language_of(path).alias("language"), F.col("length").alias("size_bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("modified"), *([F.md5("content").alias("hash"), F.decode("content", "UTF-8").alias("content")] if content else []))
    return out.where(~F.col("relative_path").rlike("|".join((skip, *IGNORED_NAMES))))


def changed_since(scanned: DataFrame, state: DataFrame) -> DataFrame:
    """Files never scanned, or modified after their last scan; state: path, last_scanned. A file without a modification
    time counts as changed."""
    s = state.groupBy("path").agg(F.max("last_scanned").alias("_last"))
    return scanned.join(s, "path", "left").where(F.col("_last").isNull() | F.col("modified").isNull() | (F.col("modified") > F.col("_last"))).drop("_last")


def decision_records(spark: SparkSession, root: str) -> DataFrame:
    """path, title, status, date of the Markdown decision records below root."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    pick = lambda p: F.nullif(F.trim(F.regexp_extract("value", p, 1)), F.lit(""))
    return t.select("path", pick(r"(?m)^#\s+(.+)$").alias("title"), F.lower(F.coalesce(pick(r"(?im)^(?:\*\*)?status(?:\*\*)?\s*:\s*(?:\*\*)?\s*(\w+)"), pick(r"(?im)^##\s*status\s*\n+\s*(\w+)"), F.lit("unknown"))).alias("status"), pick(r"(?im)^(?:\*\*)?date(?:\*\*)?\s*:\s*(?:\*\*)?\s*([0-9-]+)").alias("date"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """path, kind, package, version of all dependencies in package manifests below root; of a package in several maps the
    later map wins (prod, dev, peer, optional)."""
    schema = "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>"
    j = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "package.json").json(root).withColumn("path", F.col("_metadata.file_path"))
    kinds = ((0, "dependencies", "prod"), (1, "devDependencies", "dev"), (2, "peerDependencies", "peer"), (3, "optionalDependencies", "optional"))
    every = F.flatten(F.array(*[F.transform(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))), _tag(n, k)) for n, c, k in kinds]))
    x = j.select("path", F.explode(every).alias("d")).select("path", "d.*")
    return x.groupBy("path", "package").agg(F.max_by(F.struct("kind", "version"), "n").alias("r")).select("path", "r.kind", "package", F.regexp_replace("r.version", r"^[\^~]+", "").alias("version"))


def _tag(n: int, kind: str):
    return lambda e: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), e["key"].alias("package"), e["value"].alias("version"))


def aliases(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(prefix, target) of the path aliases of a compiler configuration, with all targets of each prefix in their order; a
    trailing star is dropped. A handful of settings."""
    import json

    text = "".join(r.value for r in spark.read.text(path, wholetext=True).take(1))
    paths = json.loads(text or "{}").get("compilerOptions", {}).get("paths", {})
    return [(k.removesuffix("*"), t.removesuffix("*").removeprefix("./")) for k, ts in paths.items() for t in ts]


def tables_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables of a folder, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
    return sorted(f.getPath().getName().removesuffix(".parquet") for f in found if f.getPath().getName().endswith(".parquet"))


def catalog(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """name, row_count of tables in a folder (counts come from the footers)."""
    out = None
    for n in names:
        c = spark.read.parquet(f"{folder}/{n}.parquet").agg(F.count("*").alias("row_count")).select(F.lit(n).alias("name"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out
