"""Whole jobs made of the operators: ingest of a folder, reload, split of a series, batched uploads, snapshots, settings, template files."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imaging_engine.functions import deid
from imaging_engine.operators.ready_files import blank_to, ordinal, rollup, with_series
from imaging_engine.shared import table
from imaging_engine.sources import dicom, files

ATTEMPTS, CHUNK = 3, 10
#: The groups and the number of elements that the simple reader lists: it stops once more than 2000 are there (fixed values).
SIMPLE_GROUPS = (0x0008, 0x0010, 0x0018, 0x0020, 0x0028, 0x0040)
SIMPLE_MOST = 2001


def ingest(spark: SparkSession, folder: str, seed: str = deid.SEED) -> tuple[DataFrame, DataFrame]:
    """(elements, digests) of the imaging files of a folder: anonymised elements, and the digest of the pixels by path; unreadable files have neither."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    raw = raw.join(files.imaging_files(spark, folder).select("length", F.col("path").alias("p")), F.regexp_replace(raw.path, "^file:/+", "/") == F.col("p"), "left_semi")
    e = dicom.elements(raw).where("key IS NOT NULL AND key NOT LIKE '%/%'")
    number = lambda at: F.conv(F.substring("key", at, 4), 16, 10).cast("int")
    rows = e.select("file", F.col("key").alias("tag"), number(1).alias("grp"), number(6).alias("elem"), "vr", "value")
    return deid.anonymised(rows, seed), dicom.digest_report(raw).select("path", F.col("d_raw").alias("hash"))


def reload(spark: SparkSession, folder: str) -> DataFrame:
    """The series rollup of a folder of imaging files, read again."""
    e = dicom.read(spark, folder)
    first = lambda k: F.min_by("value", F.when(F.col("key") == k, F.col("ord")))
    named = {"series_uid": "0020,000E", "patient_name": "0010,0010", "examination": "0008,1030", "patient_id": "0010,0020", "study_date": "0008,0020", "modality": "0008,0060", "series_description": "0008,103E", "series_number": "0020,0011"}
    rows = e.groupBy("file").agg(*[first(k).alias(n) for n, k in named.items()])
    sized = rows.withColumns({"path": F.col("file"), "file_id": F.lit(0).cast("bigint"), "file_size": F.lit(None).cast("bigint"), "duplicate_series_urls": F.array().cast("array<string>")})
    return rollup(with_series(sized))


def export_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(set_path, path): the folder itself where it has .dcm files of its own, else each of its folders that has any below it."""
    root = folder.rstrip("/")
    rest = F.substring_index(F.substring("path", len(root) + 2, 100_000), "/", 1)
    all_ = files.walk(spark, folder, extension="dcm").withColumn("first", rest)
    own = all_.where(F.col("path") == F.concat(F.lit(root + "/"), F.col("first")))
    if own.limit(1).count():
        return own.select(F.lit(root).alias("set_path"), "path")
    return all_.select(F.concat(F.lit(root + "/"), F.col("first")).alias("set_path"), "path")


def split_series(rows: DataFrame, series: str, value: Column, order: str) -> DataFrame:
    """Adds new_uid: files of a series by their value of a tag (blank where missing); the value seen first keeps the series' UID, each other one has
    a derived UID. A series with one value stays whole."""
    rows = rows.withColumn("__v", F.coalesce(F.trim(value), F.lit("")))
    firsts = rows.groupBy(series, "__v").agg(F.min(order).alias("__first"))
    firsts = firsts.withColumn("__n", F.row_number().over(Window.partitionBy(series).orderBy("__first")))
    uid = F.when(F.col("__n") == 1, F.col(series)).otherwise(deid.derived_uid(F.col(series), F.col("__v")))
    keyed = firsts.select(F.col(series).alias("__s"), F.col("__v").alias("__w"), uid.alias("new_uid"))
    return rows.join(keyed, (F.col(series) == F.col("__s")) & (F.col("__v") == F.col("__w"))).drop("__s", "__w", "__v")


def upload(rows: DataFrame, send: Callable[[list[str]], dict], attempts: int = ATTEMPTS) -> DataFrame:
    """(scan_id, chunk, path, status) of the files (scan_id, path, chunk), sent in their chunks. send gives lists of uploaded, duplicates and failed; a
    chunk that raises is sent again, and fails as a whole after the last attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for scan, chunk, paths in zip(*(c.to_pylist() for c in batch.columns)):
                answer: dict | None = None
                for _ in range(attempts):
                    try:
                        answer = send(paths)
                        break
                    except OSError:
                        continue
                told = {p: "failed" for p in paths}
                if answer is not None:
                    told = {p: s for s in ("uploaded", "duplicates", "failed") for p in answer.get(s, ())}  # the later list weighs more
                out += [(scan, chunk, p, told.get(p, "failed")) for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["scan_id", "chunk", "path", "status"])

    chunks = rows.groupBy("scan_id", "chunk").agg(F.sort_array(F.collect_list("path")).alias("paths"))  # ten paths at most
    return chunks.mapInArrow(run, "scan_id bigint, chunk bigint, path string, status string")


def snapshot(df: DataFrame, folder: str, view: str | None = None) -> DataFrame:
    """Writes the result in place of the last one, and shows it as a view."""
    df.write.mode("overwrite").parquet(folder)
    kept = df.sparkSession.read.parquet(folder)
    if view:
        kept.createOrReplaceTempView(view)
    return kept


def merged_settings(path: str, name: str, value: object) -> dict:
    """Sets one value in a JSON file of settings and keeps the others; a broken file counts as empty."""
    try:
        with open(path) as f:
            kept = json.load(f)
    except (OSError, ValueError):
        kept = {}
    kept = {**(kept if isinstance(kept, dict) else {}), name: value}
    with open(path + ".new", "w") as f:
        json.dump(kept, f, indent=2)
    os.replace(path + ".new", path)
    return kept


def template_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, ord, title, codes, modalities, body, vars) of the YAML files in project/ and then user/; what is no template of YAML is a body with its file's name."""
    rows: list[tuple] = []
    for part in ("project", "user"):
        where = os.path.join(folder, part)
        for name in sorted(os.listdir(where)) if os.path.isdir(where) else ():
            with open(os.path.join(where, name), encoding="utf-8") as f:
                text = f.read()
            rows.append((*_template(text, os.path.splitext(name)[0]), len(rows)))
    return spark.createDataFrame(rows, "id string, title string, codes array<string>, modalities array<string>, body string, vars map<string,string>, ord int")


def _template(text: str, stem: str) -> tuple:
    try:
        import yaml

        t = yaml.safe_load(text)
        if isinstance(t, dict) and isinstance(t.get("body"), str):
            as_list = lambda k: [str(x) for x in t.get(k) or []]
            return t.get("id"), t.get("title"), as_list("applicable_codes"), as_list("modalities"), t["body"], {str(k): str(v) for k, v in (t.get("vars") or {}).items()}
    except Exception:  # noqa: BLE001  a broken file is a template of its text
        pass
    return stem, None, [], [], text, {}


def now_variables(at: Column) -> tuple[Column, Column]:
    return F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "HH:mm")


def run_id(at: Column) -> Column:
    return F.concat(F.lit("run-"), F.unix_millis(at).cast("string"))


def dt07_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    date, time = now_variables(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", date.alias("date"), time.alias("time"))


def dt08_run_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", run_id(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("run"))


def agg11_older_sameness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As an older viewer had it: files before the first that has the key don't count, a file after it must have its value."""
    from imaging_engine.operators.compare import study

    rows = study(spark, sf_dir)
    every = rows.select("run", "file").distinct()
    first = rows.groupBy("run", "key").agg(F.min("file").alias("start"), F.count(F.lit(1)).alias("n"), F.min(F.coalesce("value", F.lit(""))).alias("lo"), F.max(F.coalesce("value", F.lit(""))).alias("hi"))
    ranked = every.withColumn("at", F.row_number().over(Window.partitionBy("run").orderBy("file"))).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("run")))
    j = first.join(ranked, (first.run == ranked.run) & (F.col("start") == F.col("file"))).select(first.run, "key", ((F.col("n") == F.col("of") - F.col("at") + 1) & (F.col("lo") == F.col("hi"))).alias("same"))
    return j


def agg12_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct values of a tag in each series, in the order in which they are seen first."""
    rows = table(spark, sf_dir, "ready_files").where("series_description IS NOT NULL AND trim(series_uid) <> ''")
    firsts = rows.groupBy(F.trim("series_uid").alias("series_uid"), "series_description").agg(F.min("file_id").alias("first"))
    return ordinal(firsts, ["series_uid"], ["first"]).select("series_uid", "series_description", F.col("n").cast("bigint").alias("n"))


def plan_split_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New UIDs of the files of each series by their description."""
    rows = with_series(table(spark, sf_dir, "ready_files")).select("file_id", "series_uid", "series_description")
    return split_series(rows, "series_uid", F.col("series_description"), "file_id").select("file_id", "new_uid")


def src10_simple_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of the simple reader's groups, in order, as many as it lists."""
    w = Window.partitionBy("file").orderBy("grp", "elem")
    return deid.elements(spark, sf_dir).where(F.col("grp").isin(*SIMPLE_GROUPS)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= SIMPLE_MOST).select("file", "tag", "value")


def src12_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each file were read, and how many errors there were."""
    rows = dicom.elements(dicom.made_files(spark, sf_dir))
    return rows.groupBy("file").agg(F.count_if(F.col("key").isNotNull() & (F.col("vr") != "SQ")).alias("read"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def src13_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded pixels of each file, by their sum, and what was wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [dicom.pixels(dicom.parse(c)) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e for e, _ in found], pa.string()), pa.array([None if a is None else float(a.sum()) for _, a in found], pa.float64())], ["path", "error", "total"])

    return dicom.made_files(spark, sf_dir).mapInArrow(run, "path string, error string, total double")


def snk05_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot's rows sent in chunks of ten of each scan, by a sender that takes what ends in an even digit."""
    rows = ordinal(table(spark, sf_dir, "series_info").select("scan_id", "row_id", F.col("row_id").cast("string").alias("path")), ["scan_id"], ["row_id"])
    rows = rows.withColumn("chunk", F.floor((F.col("n") - 1) / CHUNK))
    return upload(rows, lambda paths: {"uploaded": [p for p in paths if p[-1] in "02468"], "duplicates": [p for p in paths if p[-1] in "13579"]})


def snk07_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series rollup as the last scan's snapshot, read back."""
    from imaging_engine.operators.ready_files import agg01_series_rollup
    from imaging_engine.shared import own_folder

    return snapshot(agg01_series_rollup(spark, sf_dir), own_folder(spark, "snapshot")).select("series_uid", "file_count", blank_to(F.col("modality"), "").alias("modality"))


_F = "f AS (SELECT file_id, coalesce(nullif(trim(series_uid), ''), 'NO_SERIES') AS series_uid, coalesce(trim(series_description), '') AS v FROM ready_files)"


def _sql() -> dict[str, str]:
    from imaging_engine.functions.deid import _E
    from imaging_engine.operators.compare import _W

    return {
        "dt07_now": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time FROM events",
        "dt08_run_id": "SELECT event_id, 'run-' || epoch_ms(date_trunc('second', ts)) AS run FROM events",
        "agg11_older_sameness": f"WITH {_W}, r AS (SELECT run, file, row_number() OVER (PARTITION BY run ORDER BY file) AS pos, count(*) OVER (PARTITION BY run) AS n FROM (SELECT DISTINCT run, file FROM w)), g AS (SELECT run, key, min(file) AS start, count(*) AS c, count(DISTINCT coalesce(value, '')) AS d FROM w GROUP BY 1, 2) SELECT g.run, key, c = n - pos + 1 AND d = 1 AS same FROM g JOIN r ON g.run = r.run AND g.start = r.file",
        "agg12_first_seen": "WITH g AS (SELECT trim(series_uid) AS series_uid, series_description, min(file_id) AS f FROM ready_files WHERE series_description IS NOT NULL AND trim(series_uid) <> '' GROUP BY 1, 2) SELECT series_uid, series_description, row_number() OVER (PARTITION BY series_uid ORDER BY f) AS n FROM g",
        "plan_split_series": f"WITH {_F}, g AS (SELECT series_uid, v, row_number() OVER (PARTITION BY series_uid ORDER BY min(file_id)) AS n FROM f GROUP BY 1, 2) SELECT file_id, CASE WHEN n = 1 THEN f.series_uid ELSE '2.25.' || CAST(CAST('0x' || substr(sha256(f.series_uid || ':split:' || f.v), 1, 32) AS UHUGEINT) AS VARCHAR) END AS new_uid FROM f JOIN g USING (series_uid, v)",
        "src10_simple_reader": f"WITH {_E} SELECT file, tag, value FROM el WHERE grp IN (8, 16, 24, 32, 40, 64) QUALIFY row_number() OVER (PARTITION BY file ORDER BY grp, elem) <= 2001",
        "src12_diagnostics": "SELECT printf('S%08d.dcm', row_id) AS file, 10::BIGINT AS read, 0::BIGINT AS errors FROM series_info",
        "src13_pixels": "SELECT printf('S%08d.dcm', row_id) AS path, NULL::VARCHAR AS error, (row_id % 5 + row_id % 7 + 7)::DOUBLE AS total FROM series_info",
        "snk05_batches": "SELECT scan_id, CAST(floor((row_number() OVER (PARTITION BY scan_id ORDER BY row_id) - 1) / 10) AS BIGINT) AS chunk, row_id::VARCHAR AS path, CASE WHEN row_id % 2 = 0 THEN 'uploaded' ELSE 'duplicates' END AS status FROM series_info",
        "snk07_snapshot": "SELECT coalesce(nullif(trim(series_uid), ''), 'NO_SERIES') AS series_uid, count(*) AS file_count, coalesce(arg_min(modality, row(path, file_id)) FILTER (WHERE modality IS NOT NULL), '') AS modality FROM ready_files GROUP BY 1",
    }


SQL = _sql()
QUERIES = {name: globals()[name] for name in SQL}
