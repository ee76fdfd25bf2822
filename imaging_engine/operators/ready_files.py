"""Ready files and series: projection, grouping, duplicate lookup, totals, chunks.

The file lists of a series are never collected: files stay rows, and what is taken over a series are aggregates that combine before the
shuffle. A missing series is NO_SERIES. Of a path listed several times, the row with the smallest file_id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imaging_engine.operators.skew import NO_SERIES
from imaging_engine.shared import table

ATTRIBUTES = ("patient_name", "examination", "patient_id", "study_date", "modality", "series_description", "series_number")
CHUNK = 10


def blank_to(c: Column, default: str | Column) -> Column:
    """The text, or the default where it is null or blank."""
    return F.when(F.trim(c) != "", c).otherwise(F.lit(default) if isinstance(default, str) else default)


def with_series(rows: DataFrame) -> DataFrame:
    return rows.withColumn("series_uid", blank_to(F.trim("series_uid"), NO_SERIES))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_series(table(spark, sf_dir, "ready_files"))


_F = "f AS (SELECT * REPLACE (coalesce(nullif(trim(series_uid), ''), 'NO_SERIES') AS series_uid) FROM ready_files)"


def prj01_ready_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of a file as columns, its size and its series."""
    return files(spark, sf_dir).select("file_id", "path", "series_uid", *ATTRIBUTES, F.coalesce("file_size", F.lit(0)).alias("file_size"))


def series_label(number: Column, description: Column) -> Column:
    text = blank_to(description, "(no description)")
    return F.when(F.trim(number) != "", F.concat(F.lit("Series "), F.trim(number), F.lit(" - "), text)).otherwise(F.concat(F.lit("Series - "), text))


def prj02_series_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "series_info").select("row_id", series_label(F.col("series_number"), F.col("series_description")).alias("label"))


def _tenths(n: Column, unit: int, name: str) -> Column:
    """n in the unit to one decimal place, halves up, in whole numbers."""
    tenths = F.floor((n * 10 + unit // 2) / F.lit(unit).cast("decimal(20,0)")).cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" " + name))


def size_si(n: Column) -> Column:
    return F.when(n >= 1_000_000, _tenths(n, 1_000_000, "MB")).when(n >= 1_000, _tenths(n, 1_000, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def size_iec(n: Column) -> Column:
    """By 1024, one decimal place; what is no number is 0 B."""
    out = F.when(n.isNull(), F.lit("0 B"))
    for k in range(5, 0, -1):
        out = out.when(n >= 1024**k, _tenths(n, 1024**k, ("B", "KiB", "MiB", "GiB", "TiB", "PiB")[k]))
    return out.otherwise(_tenths(n, 1, "B"))


def prj03_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study's and the series' header lines."""
    dash = F.lit(" — ")
    study = F.concat(F.lit("Study: "), blank_to(F.col("study_date"), "Unknown date"), dash, blank_to(F.col("examination"), "Unknown exam"))
    text = blank_to(F.col("series_description"), blank_to(F.col("series_number"), "Series"))
    files_ = F.concat(F.coalesce("file_count", F.lit(0)).cast("string"), F.lit(" files"))
    series = F.concat(blank_to(F.col("modality"), "Unknown"), dash, text, dash, files_, dash, size_si(F.coalesce("total_bytes", F.lit(0))))
    return table(spark, sf_dir, "series_info").select("row_id", study.alias("study_header"), series.alias("series_header"))


def prj04_size_si(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "series_info").where("total_bytes IS NOT NULL").select("row_id", size_si(F.col("total_bytes")).alias("size"))


def prj05_size_iec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "series_info").select("row_id", size_iec(F.col("total_bytes")).alias("size"))


def absolute_url(url: Column, base: str) -> Column:
    base = base.rstrip("/")
    return F.when(url.startswith("http"), url).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(F.concat(F.lit(base + "/"), url))


def prj06_absolute_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ready_files").select("file_id", absolute_url(F.col("path"), "https://pacs.example/").alias("url"), absolute_url(F.element_at(F.split("path", "/"), -1), "https://pacs.example").alias("name_url"))


def rollup(rows: DataFrame) -> DataFrame:
    """One row per series: files, bytes, the first non-null value of each attribute in the order of paths, the distinct urls."""
    first = lambda a: F.min_by(a, F.when(F.col(a).isNotNull(), F.struct("path", "file_id"))).alias(a)
    return rows.groupBy("series_uid").agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"), *map(first, ATTRIBUTES),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("duplicate_series_urls")))), ",").alias("urls"),
    )


def agg01_series_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(files(spark, sf_dir))


def agg02_series_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the rollup, but the attributes are those of the first file, nulls included, and urls are counted with repeats."""
    one = F.min_by(F.struct(*ATTRIBUTES), F.struct("path", "file_id")).alias("a")
    df = files(spark, sf_dir).groupBy("series_uid").agg(F.count(F.lit(1)).alias("file_count"), F.sum(F.greatest(F.coalesce(F.size("duplicate_series_urls"), F.lit(0)), F.lit(0))).cast("bigint").alias("n_urls"), one)
    return df.select("series_uid", "file_count", "n_urls", *[F.col(f"a.{a}").alias(a) for a in ATTRIBUTES])


def agg03_quick_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files as one group, unread."""
    return table(spark, sf_dir, "ready_files").agg(F.count(F.lit(1)).alias("file_count")).select(F.lit(NO_SERIES).alias("series_uid"), "file_count", F.lit(0).cast("bigint").alias("total_bytes"))


def study_groups(rows: DataFrame) -> DataFrame:
    """Series by patient, examination and date (null as empty); row_id tells the order, so that the first row places the group."""
    return rows.groupBy(*[F.coalesce(c, F.lit("")).alias(c) for c in ("patient_name", "examination", "study_date")]).agg(
        F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n_series"), F.coalesce(F.sum("total_bytes"), F.lit(0)).cast("bigint").alias("total_bytes")
    )


def agg04_study_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_groups(table(spark, sf_dir, "series_info"))


def agg05_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "series_info").agg(F.coalesce(F.sum("file_count"), F.lit(0)).cast("bigint").alias("files"), F.coalesce(F.sum("total_bytes"), F.lit(0)).cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("n_series"))


def agg06_duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy("series_uid").agg(F.count_if("is_duplicate").alias("duplicates"))


def agg07_series_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that have a size, their bytes, the description written last."""
    last = F.max_by("series_description", F.when(F.col("series_description").isNotNull(), F.col("file_id")))
    return files(spark, sf_dir).where("file_size IS NOT NULL").groupBy("series_uid").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"), last.alias("description"))


def agg08_series_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by("series_description", F.when(F.col("series_description").isNotNull(), F.col("row_id")))
    return with_series(table(spark, sf_dir, "series_info")).groupBy("series_uid").agg(last.alias("description"), F.count(F.lit(1)).alias("n"))


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows that are first of their key, and those without one; by a minimum, which combines before the shuffle, not by a window."""
    firsts = rows.where(F.col(key) != "").groupBy(key).agg(F.min(order).alias(order)).select(order)
    return rows.where(F.coalesce(F.col(key), F.lit("")) == "").unionByName(rows.where(F.col(key) != "").join(firsts, order, "left_semi"))


def agg09_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(table(spark, sf_dir, "ready_files").select("file_id", "hash", "path"), "hash", "file_id")


def agg18_status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the status that weighs most: failed (no hash), then duplicate, then uploaded."""
    status = F.when(F.coalesce("hash", F.lit("")) == "", 3).when(F.col("is_duplicate"), 2).otherwise(1)
    worst = table(spark, sf_dir, "ready_files").groupBy("path").agg(F.max(status).alias("s"))
    return worst.groupBy(F.element_at(F.array(F.lit("uploaded"), F.lit("duplicate"), F.lit("failed")), F.col("s")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def flt04_in_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a directory (by whole path parts) that are listed in the metadata."""
    there = table(spark, sf_dir, "comps").select(F.col("file_path").alias("path"))
    return table(spark, sf_dir, "ready_files").where(F.col("path").startswith("/ingest/north/")).join(there, "path", "left_semi").select("file_id", "path")


def flt05_evict_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with the files that are still listed; series without any are dropped."""
    there = table(spark, sf_dir, "comps").select(F.col("file_path").alias("path"))
    return files(spark, sf_dir).join(there, "path", "left_semi").groupBy("series_uid").agg(F.count(F.lit(1)).alias("n"))


def flt06_not_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ready_files").where(~F.coalesce("is_duplicate", F.lit(False))).select("file_id", "path")


def flt07_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ready_files").where(F.trim("hash") != "").select("file_id", "hash")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, url) of the accepted files: one row for each hash. It grows with history, so no join hints at a broadcast."""
    rows = table(spark, sf_dir, "ready_files").where("accepted AND hash <> ''")
    return rows.groupBy("hash").agg(F.min("file_id").alias("of_file"), F.concat(F.lit("/series/"), F.min("series_uid")).alias("url"))


def joi01_preserve_on_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit in the registry sets the flag and the url; a miss keeps what was stored."""
    reg = registry(spark, sf_dir).select("hash", "url")
    new = table(spark, sf_dir, "ready_files").where("NOT accepted")
    stored = F.array_join("duplicate_series_urls", ",")
    return new.join(reg, "hash", "left").select("file_id", F.coalesce(F.col("url").isNotNull() | F.lit(None), F.col("is_duplicate")).alias("is_duplicate"), F.coalesce("url", stored).alias("urls"))


def joi02_hit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every new path of a known hash."""
    return table(spark, sf_dir, "ready_files").where("NOT accepted").join(registry(spark, sf_dir), "hash").select("file_id", "path", "of_file")


def joi03_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files whose hash isn't known, those without a hash among them."""
    return table(spark, sf_dir, "ready_files").where("NOT accepted").join(registry(spark, sf_dir), "hash", "left_anti").select("file_id")


def joi04_flagged_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the snapshot whose series has a flagged file."""
    flagged = files(spark, sf_dir).where("is_duplicate").select("series_uid")
    return table(spark, sf_dir, "series_info").join(flagged, "series_uid", "left_semi").select("row_id", "series_uid")


def joi05_still_to_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ready_files").where("hash <> ''")
    return rows.where("NOT accepted").select("hash").subtract(rows.where("accepted").select("hash"))


def base_name(path: Column) -> Column:
    """What follows the last separator, in either style of paths."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def joi06_by_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments' files found again by their name: the first path of each name within the scan answers."""
    rows = table(spark, sf_dir, "ready_files").select("scan_id", "file_id", "path", base_name(F.col("path")).alias("name"))
    firsts = rows.groupBy("scan_id", "name").agg(F.min_by("path", F.struct("path", "file_id")).alias("first_path"))
    return rows.join(firsts, ["scan_id", "name"]).select("file_id", "first_path")


def set06_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of two result lists, and how many urls each has in all."""
    rows = table(spark, sf_dir, "ready_files")
    a = rows.where("is_duplicate").select("series_uid", F.lit("stored").alias("src"))
    b = rows.where("NOT accepted").join(registry(spark, sf_dir), "hash", "left_semi").select("series_uid", F.lit("looked up").alias("src"))
    return a.unionByName(b).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


def set07_distinct_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ready_files").where("hash <> ''").select("hash").distinct()


def srt01_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by key, files by path: the order as a table is one sort by ranges, no task sees it all."""
    return files(spark, sf_dir).select("series_uid", "path", "file_id").orderBy("series_uid", "path", "file_id")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new in place of those of old with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def snk04_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest by path after all scans: the last listing of each path."""
    rows = table(spark, sf_dir, "ready_files").select("path", "file_id", "file_size")
    last = rows.groupBy("path").agg(F.max_by(F.struct("file_id", "file_size"), "file_id").alias("r")).select("path", "r.file_id", "r.file_size")
    old, new = (last.where(c) for c in ("file_id % 2 = 0", "file_id % 2 = 1"))
    return upsert(old, new, "path")


def ordinal(rows: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Rows numbered from 1 within their group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal(table(spark, sf_dir, "series_info").select("scan_id", "row_id", "series_uid"), ["scan_id"], ["row_id"])


def win03_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of ten in the order of each scan's list."""
    return _chunked(spark, sf_dir).select("row_id", F.floor((F.col("n") - 1) / CHUNK).alias("chunk"))


def win04_first_seen_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a series in the order of their first appearance; the first keeps the series."""
    firsts = table(spark, sf_dir, "series_info").where("series_description IS NOT NULL").groupBy("series_uid", "series_description").agg(F.min("row_id").alias("first_row"))
    return firsts.withColumn("rank", F.dense_rank().over(Window.partitionBy("series_uid").orderBy("first_row")).cast("bigint") - 1).select("series_uid", "series_description", "rank")


def win05_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir).select("row_id", F.format_string("IMG_%03d.dcm", F.col("n") - 1).alias("name"))


def win06_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five snapshots of each series (a kept history is the feature)."""
    w = Window.partitionBy("series_uid").orderBy(F.desc("row_id"))
    return table(spark, sf_dir, "series_info").withColumn("n", F.row_number().over(w)).where("n <= 5").select("series_uid", "row_id")


def win07_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of a scan report progress: each tenth part, and the last."""
    n = F.count(F.lit(1)).over(Window.partitionBy("scan_id"))
    df = _chunked(spark, sf_dir).withColumn("of", n)
    return df.where((F.col("n") % F.greatest(F.lit(1), F.floor(F.col("of") / 10)) == 0) | (F.col("n") == F.col("of"))).select("scan_id", "row_id", F.floor(100 * F.col("n") / F.col("of")).alias("percent"))


def snk08_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten series seen last, each once."""
    rows = files(spark, sf_dir).where("series_uid <> 'NO_SERIES'").groupBy("series_uid").agg(F.max("file_id").alias("last"))
    return rows.orderBy(F.desc("last")).limit(10)


_ARG = ", ".join(f"arg_min({a}, row(path, file_id)) FILTER (WHERE {a} IS NOT NULL) AS {a}" for a in ATTRIBUTES)
_REG = "reg AS (SELECT hash, min(file_id) AS of_file, '/series/' || min(series_uid) AS url FROM ready_files WHERE accepted AND hash <> '' GROUP BY 1)"
_TENTHS = "CAST(({0} * 10 + {1} // 2) // {1} // 10 AS VARCHAR) || '.' || CAST(({0} * 10 + {1} // 2) // {1} % 10 AS VARCHAR) || ' {2}'"
_SI = "CASE WHEN {0} >= 1000000 THEN " + _TENTHS.format("{0}", 1_000_000, "MB") + " WHEN {0} >= 1000 THEN " + _TENTHS.format("{0}", 1_000, "KB") + " ELSE {0}::VARCHAR || ' B' END"
_IEC = "CASE WHEN total_bytes IS NULL THEN '0 B' " + " ".join(f"WHEN total_bytes >= {1024**k} THEN " + _TENTHS.format("total_bytes", 1024**k, u) for k, u in ((5, "PiB"), (4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB"))) + " ELSE " + _TENTHS.format("total_bytes", 1, "B") + " END"
_NUMBERED = "c AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY row_id) AS n, count(*) OVER (PARTITION BY scan_id) AS nn FROM series_info)"

SQL = {
    "prj01_ready_projection": f"WITH {_F} SELECT file_id, path, series_uid, {', '.join(ATTRIBUTES)}, coalesce(file_size, 0) AS file_size FROM f",
    "prj02_series_label": "SELECT row_id, CASE WHEN trim(series_number) <> '' THEN 'Series ' || trim(series_number) || ' - ' ELSE 'Series - ' END || CASE WHEN trim(series_description) <> '' THEN series_description ELSE '(no description)' END AS label FROM series_info",
    "prj03_headers": f"""SELECT row_id, 'Study: ' || coalesce(CASE WHEN trim(study_date) <> '' THEN study_date END, 'Unknown date') || ' — ' || coalesce(CASE WHEN trim(examination) <> '' THEN examination END, 'Unknown exam') AS study_header,
coalesce(CASE WHEN trim(modality) <> '' THEN modality END, 'Unknown') || ' — ' || coalesce(CASE WHEN trim(series_description) <> '' THEN series_description END, CASE WHEN trim(series_number) <> '' THEN series_number END, 'Series')
|| ' — ' || coalesce(file_count, 0)::VARCHAR || ' files — ' || {_SI.format('coalesce(total_bytes, 0)')} AS series_header FROM series_info""",
    "prj04_size_si": f"SELECT row_id, {_SI.format('total_bytes')} AS size FROM series_info WHERE total_bytes IS NOT NULL",
    "prj05_size_iec": f"SELECT row_id, {_IEC} AS size FROM series_info",
    "prj06_absolute_url": "SELECT file_id, CASE WHEN starts_with(path, 'http') THEN path WHEN starts_with(path, '/') THEN 'https://pacs.example' || path ELSE 'https://pacs.example/' || path END AS url, CASE WHEN starts_with(n, 'http') THEN n ELSE 'https://pacs.example/' || n END AS name_url FROM (SELECT file_id, path, split_part(path, '/', -1) AS n FROM ready_files)",
    "agg01_series_rollup": f"WITH {_F}, u AS (SELECT series_uid, string_agg(DISTINCT u, ',' ORDER BY u) AS urls FROM (SELECT series_uid, unnest(duplicate_series_urls) AS u FROM f) GROUP BY 1), g AS (SELECT series_uid, count(*) AS file_count, coalesce(sum(file_size), 0)::BIGINT AS total_bytes, {_ARG} FROM f GROUP BY 1) SELECT g.*, coalesce(urls, '') AS urls FROM g LEFT JOIN u USING (series_uid)",
    "agg02_series_scan": f"WITH {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY series_uid ORDER BY path, file_id) AS rn FROM f), g AS (SELECT series_uid, count(*) AS file_count, sum(coalesce(len(duplicate_series_urls), 0))::BIGINT AS n_urls FROM f GROUP BY 1) SELECT g.*, {', '.join(ATTRIBUTES)} FROM g JOIN r USING (series_uid) WHERE rn = 1",
    "agg03_quick_scan": "SELECT 'NO_SERIES' AS series_uid, count(*) AS file_count, 0::BIGINT AS total_bytes FROM ready_files",
    "agg04_study_groups": "SELECT coalesce(patient_name, '') AS patient_name, coalesce(examination, '') AS examination, coalesce(study_date, '') AS study_date, min(row_id) AS first_row, count(*) AS n_series, coalesce(sum(total_bytes), 0)::BIGINT AS total_bytes FROM series_info GROUP BY 1, 2, 3",
    "agg05_totals": "SELECT coalesce(sum(file_count), 0)::BIGINT AS files, coalesce(sum(total_bytes), 0)::BIGINT AS bytes, count(*) AS n_series FROM series_info",
    "agg06_duplicate_count": f"WITH {_F} SELECT series_uid, count(*) FILTER (WHERE is_duplicate) AS duplicates FROM f GROUP BY 1",
    "agg07_series_card": f"WITH {_F} SELECT series_uid, count(*) AS n, sum(file_size)::BIGINT AS bytes, arg_max(series_description, file_id) FILTER (WHERE series_description IS NOT NULL) AS description FROM f WHERE file_size IS NOT NULL GROUP BY 1",
    "agg08_series_grid": "SELECT coalesce(nullif(trim(series_uid), ''), 'NO_SERIES') AS series_uid, arg_max(series_description, row_id) FILTER (WHERE series_description IS NOT NULL) AS description, count(*) AS n FROM series_info GROUP BY 1",
    "agg09_keep_first": "SELECT file_id, hash, path FROM ready_files QUALIFY coalesce(hash, '') = '' OR row_number() OVER (PARTITION BY hash ORDER BY file_id) = 1",
    "agg18_status_tally": "SELECT CASE s WHEN 1 THEN 'uploaded' WHEN 2 THEN 'duplicate' ELSE 'failed' END AS status, count(*) AS n FROM (SELECT path, max(CASE WHEN coalesce(hash, '') = '' THEN 3 WHEN is_duplicate THEN 2 ELSE 1 END) AS s FROM ready_files GROUP BY 1) GROUP BY 1",
    "flt04_in_directory": "SELECT file_id, path FROM ready_files WHERE starts_with(path, '/ingest/north/') AND path IN (SELECT file_path FROM comps WHERE file_path IS NOT NULL)",
    "flt05_evict_missing": f"WITH {_F} SELECT series_uid, count(*) AS n FROM f WHERE path IN (SELECT file_path FROM comps WHERE file_path IS NOT NULL) GROUP BY 1",
    "flt06_not_duplicate": "SELECT file_id, path FROM ready_files WHERE NOT coalesce(is_duplicate, false)",
    "flt07_hashed": "SELECT file_id, hash FROM ready_files WHERE trim(hash) <> ''",
    "joi01_preserve_on_miss": f"WITH {_REG} SELECT file_id, CASE WHEN url IS NOT NULL THEN true ELSE is_duplicate END AS is_duplicate, coalesce(url, array_to_string(duplicate_series_urls, ',')) AS urls FROM ready_files LEFT JOIN reg USING (hash) WHERE NOT accepted",
    "joi02_hit_paths": f"WITH {_REG} SELECT file_id, path, of_file FROM ready_files JOIN reg USING (hash) WHERE NOT accepted",
    "joi03_unknown": f"WITH {_REG} SELECT file_id FROM ready_files r WHERE NOT accepted AND NOT EXISTS (SELECT 1 FROM reg WHERE reg.hash = r.hash)",
    "joi04_flagged_series": f"WITH {_F} SELECT row_id, series_uid FROM series_info s WHERE EXISTS (SELECT 1 FROM f WHERE is_duplicate AND f.series_uid = s.series_uid)",
    "joi05_still_to_check": "SELECT hash FROM ready_files WHERE NOT accepted AND hash <> '' EXCEPT SELECT hash FROM ready_files WHERE accepted AND hash <> ''",
    "joi06_by_file_name": "WITH r AS (SELECT scan_id, file_id, path, regexp_extract(path, '([^/\\\\]*)$', 1) AS name FROM ready_files) SELECT file_id, first_value(path) OVER (PARTITION BY scan_id, name ORDER BY path, file_id) AS first_path FROM r WHERE scan_id IS NOT NULL AND name IS NOT NULL",
    "set06_union_all": f"WITH {_REG}, a AS (SELECT 'stored' AS src FROM ready_files WHERE is_duplicate UNION ALL SELECT 'looked up' FROM ready_files r WHERE NOT accepted AND EXISTS (SELECT 1 FROM reg WHERE reg.hash = r.hash)) SELECT src, count(*) AS n FROM a GROUP BY 1",
    "set07_distinct_hashes": "SELECT DISTINCT hash FROM ready_files WHERE hash <> ''",
    "srt01_order": f"WITH {_F} SELECT series_uid, path, file_id FROM f ORDER BY ALL",
    "snk04_upsert": "SELECT path, max(file_id) AS file_id, arg_max(row(file_size), file_id)[1] AS file_size FROM ready_files WHERE path IS NOT NULL GROUP BY 1",
    "win03_chunks": f"WITH {_NUMBERED} SELECT row_id, CAST(floor((n - 1) / 10) AS BIGINT) AS chunk FROM c",
    "win04_first_seen_rank": "WITH g AS (SELECT series_uid, series_description, min(row_id) AS first_row FROM series_info WHERE series_description IS NOT NULL GROUP BY 1, 2) SELECT series_uid, series_description, CAST(dense_rank() OVER (PARTITION BY series_uid ORDER BY first_row) - 1 AS BIGINT) AS rank FROM g",
    "win05_names": f"WITH {_NUMBERED} SELECT row_id, printf('IMG_%03d.dcm', n - 1) AS name FROM c",
    "win06_last_n": "SELECT series_uid, row_id FROM series_info QUALIFY row_number() OVER (PARTITION BY series_uid ORDER BY row_id DESC) <= 5",
    "win07_milestones": f"WITH {_NUMBERED} SELECT scan_id, row_id, CAST(floor(100 * n / nn) AS BIGINT) AS percent FROM c WHERE n % greatest(1, CAST(floor(nn / 10) AS BIGINT)) = 0 OR n = nn",
    "snk08_recent": f"WITH {_F} SELECT series_uid, max(file_id) AS last FROM f WHERE series_uid <> 'NO_SERIES' GROUP BY 1 ORDER BY last DESC LIMIT 10",
}
QUERIES = {name: globals()[name] for name in SQL}
