"""Discovery of files: recursive, by depth, by extension, by content; lists; logs with bodies. Paths and sizes are read without contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(c: Column) -> Column:
    return F.regexp_replace(c, "^file:/+", "/")


def walk(spark: SparkSession, folder: str, depth: int = -1, extension: str = "") -> DataFrame:
    """(path, length) of the files below a folder, down to a depth (0: its own files; -1: all), with an extension in any letter case."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(_path(F.col("path")).alias("path"), "length")
    if depth >= 0:
        base = folder.rstrip("/").count("/")
        df = df.where(F.size(F.split("path", "/")) - 2 - base <= depth)
    if extension:
        df = df.where(F.lower("path").endswith("." + extension.lower().lstrip(".")))
    return df


def glob(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """By name, in the pattern's letter case."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select(_path(F.col("path")).alias("path"), "length")


def glob_or_all(spark: SparkSession, folder: str, pattern: str = "*.dcm") -> DataFrame:
    """By name; where nothing has it, all files but directories of media (DICOMDIR)."""
    found = glob(spark, folder, pattern)
    return found if found.limit(1).count() else walk(spark, folder).where(F.element_at(F.split("path", "/"), -1) != "DICOMDIR")


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def imaging_files(spark: SparkSession, folder: str, openable: bool = False) -> DataFrame:
    """(path, length): .dcm and .dicom, and files without an extension that have the mark at 128; openable: any file that has it. Each once, in order.
    Contents are read only of files whose name does not decide."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = extension(F.col("path"))
    named = raw.where(ext.isin("dcm", "dicom")).select("path", "length")
    marked = F.substring("content", 129, 4) == F.lit(b"DICM")
    others = raw.where(~ext.isin("dcm", "dicom") if openable else ext == "").where(marked).select("path", "length")
    return named.union(others).select(_path(F.col("path")).alias("path"), "length").dropDuplicates(["path"]).orderBy("path")


def one_level(spark: SparkSession, folder: str, chosen: DataFrame | None = None) -> DataFrame:
    """The .dcm files of the folder itself, without those chosen already (path)."""
    df = walk(spark, folder, 0, "dcm")
    return df if chosen is None else df.join(chosen, "path", "left_anti")


def listed(spark: SparkSession, list_file: str, files: DataFrame) -> DataFrame:
    """The files that a list names, a path on each line."""
    names = spark.read.text(list_file).select(F.trim("value").alias("path")).where("path <> ''").distinct()
    return files.join(names, "path", "left_semi")


def log_lines(logs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Log lines (line) with the body (name, body) that BODY_FILE: names put in between marks; where there is no such body, the line as it is."""
    named = logs.withColumn("name", F.regexp_extract("line", r"BODY_FILE:\s*(\S+)", 1))
    shown = F.concat("line", F.lit("\n--- body ---\n"), "body", F.lit("\n--- end ---"))
    return named.join(bodies, "name", "left").select(F.coalesce(shown, "line").alias("line"))


def manifest_or_scan(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """The kept manifest (path, length); where there is none or it is empty, a scan of the folder."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest)
    if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        df = spark.read.parquet(manifest)
        if df.limit(1).count():
            return df
    return walk(spark, folder)


def setting(env: dict[str, str], saved: dict[str, str], name: str, default: str | None = None) -> str | None:
    """A setting of the environment, else the saved one, else the default; blank ones don't count."""
    return next((v for v in (env.get(name), saved.get(name)) if v and v.strip()), default)


def src01_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk(spark, sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def src02_depth_and_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk(spark, sf_dir, 1, "PARQUET").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def src20_log_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines made of fragments, whose bodies are the fragments' own."""
    from imaging_engine.shared import table

    f = table(spark, sf_dir, "manifest_fragments")
    logs = f.select(F.concat(F.lit("read BODY_FILE: "), F.when(F.col("frag_id") % 4 != 0, F.col("frag_path")).otherwise("missing")).alias("line"))
    return log_lines(logs, f.select(F.col("frag_path").alias("name"), "body"))


SQL = {"src20_log_bodies": "SELECT coalesce(l.line || chr(10) || '--- body ---' || chr(10) || b.body || chr(10) || '--- end ---', l.line) AS line FROM (SELECT 'read BODY_FILE: ' || n AS line, n FROM (SELECT CASE WHEN frag_id % 4 <> 0 THEN frag_path ELSE 'missing' END AS n FROM manifest_fragments)) l LEFT JOIN manifest_fragments b ON b.frag_path = l.n"}
QUERIES = {f.__name__: f for f in (src01_walk, src02_depth_and_extension, src20_log_bodies)}
