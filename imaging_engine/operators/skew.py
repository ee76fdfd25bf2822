"""Problem 1: results per key where a few keys hold most rows, by two-stage salted aggregation.

Defined cases: a null value is not counted; a null key column is a key of its own; a repeated row counts once (the measure is a
distinct count); an empty table gives no rows; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imaging_engine.shared import strip, table

NO_SERIES = "NO_SERIES"
#: A key is heavy beyond so many rows ...
HEAVY_ROWS = 20_000
#: ... and beyond this share of all rows; so there are fewer than HEAVY_SHARE heavy keys at any size of the input, and they can be broadcast.
HEAVY_SHARE = 2_000
_KEYS_AS = "__k"


def heavy_keys(rows: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(key columns as __k0.., salts) of the keys with more than heavy_rows rows; one salt for each heavy_rows begun. At most HEAVY_SHARE rows."""
    least = max(heavy_rows, -(-rows.count() // HEAVY_SHARE))
    counts = rows.groupBy(*[F.col(k).alias(f"{_KEYS_AS}{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > least).select(*[f"{_KEYS_AS}{i}" for i in range(len(keys))], F.ceil(F.col("n") / F.lit(least)).cast("int").alias("salts"))


def salted_distinct_count(rows: DataFrame, keys: Sequence[str], value: str, name: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """One row per key with the number of distinct values, no task holding a heavy key whole.

    The salt of a heavy key's row is a hash of the value: as even as a random one, but equal values share it, so partial counts
    add up exactly, and a task that runs again gives the same salts.
    """
    used = rows.select(*keys, value).where(F.col(value).isNotNull())
    heavy = heavy_keys(used, keys, heavy_rows)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & used[k].eqNullSafe(heavy[f"{_KEYS_AS}{i}"])
    salt = F.pmod(F.xxhash64(value), F.coalesce("salts", F.lit(1)).cast("bigint")).cast("int")
    salted = used.join(F.broadcast(heavy), same, "left").select(*keys, salt.alias("__salt"), value)
    # one exchange by key and salt serves both the distinct values and the partial counts
    partial = salted.repartition(*keys, "__salt").distinct().groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__part"))
    return partial.groupBy(*keys).agg(F.sum("__part").alias(name))


def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, series_uid, file_count) of ready_files: distinct paths; a null or blank series_uid stands for NO_SERIES."""
    uid = strip(F.col("series_uid"))
    rows = table(spark, sf_dir, "ready_files").select("scan_id", F.when(uid != "", uid).otherwise(F.lit(NO_SERIES)).alias("series_uid"), "path")
    return salted_distinct_count(rows, ["scan_id", "series_uid"], "path", "file_count")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of series_info whose file_count is null or differs from that of ready_files (0 if there are no files), each once."""
    said = table(spark, sf_dir, "series_info").select("scan_id", "series_uid", F.col("file_count").alias("said"))
    counts = file_counts(spark, sf_dir)
    there = said.alias("s").join(counts.alias("c"), F.expr("s.scan_id <=> c.scan_id AND s.series_uid <=> c.series_uid"), "left")
    return there.where("said IS NULL OR said <> coalesce(c.file_count, 0)").select("s.scan_id", "s.series_uid").distinct()


_COUNTS = """SELECT scan_id, CASE WHEN trim(coalesce(series_uid, '')) = '' THEN 'NO_SERIES' ELSE trim(series_uid) END AS series_uid, count(DISTINCT path) AS file_count
FROM ready_files WHERE path IS NOT NULL GROUP BY 1, 2"""

SQL = {
    "p1_found": f"""
WITH f AS ({_COUNTS})
SELECT DISTINCT s.scan_id, s.series_uid
FROM series_info s LEFT JOIN f ON s.scan_id IS NOT DISTINCT FROM f.scan_id AND s.series_uid IS NOT DISTINCT FROM f.series_uid
WHERE s.file_count IS NULL OR s.file_count <> coalesce(f.file_count, 0)""",
    "p1_file_counts": _COUNTS,
}
QUERIES = {"p1_found": p1_found, "p1_file_counts": file_counts}
