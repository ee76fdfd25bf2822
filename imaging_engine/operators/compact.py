"""Problem 4: many tiny files as few well-sized ones, by cumulative-size grouping.

The manifest is frozen (written), ordered, its bytes summed up by windows, and a group is an interval of target_bytes; all of this is
SQL. Then the records are rewritten group by group and the counts reconciled. Defined cases: a null or empty body holds no record; a null
or negative frag_size counts as the length of the body; a record repeated in any file is kept once, in its first group; a record cut off
before its end is none; a file_size that is not a whole number of 64 bits, and a path that is not a text, make no record; an empty manifest gives no file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imaging_engine.shared import own_folder, table

TARGET_BYTES = 128 << 20
#: So many fragments (of consecutive frag_id) make a bucket of the first level of the sums; the second level sees only buckets.
BUCKET = 100_000
_START = re.compile(r"[\[{]")

PLAN = """
WITH sums AS (SELECT bucket, sum(bytes) AS bytes FROM {manifest} GROUP BY bucket),
chunks AS (SELECT floor(bucket / 1000) AS chunk, bucket, bytes FROM sums),
chunk_sums AS (SELECT chunk, sum(bytes) AS bytes FROM chunks GROUP BY chunk),
chunk_before AS (
  -- one row for BUCKET * 1000 fragments: the only window without a partition sees those few
  SELECT chunk, coalesce(sum(bytes) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunk_sums),
bucket_before AS (
  SELECT c.bucket, k.before + coalesce(sum(c.bytes) OVER (PARTITION BY c.chunk ORDER BY c.bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM chunks c JOIN chunk_before k ON c.chunk = k.chunk),
placed AS (
  SELECT m.frag_id, b.before + coalesce(sum(m.bytes) OVER (PARTITION BY m.bucket ORDER BY m.frag_id, m.frag_path, m.bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {manifest} m JOIN bucket_before b ON m.bucket = b.bucket)
SELECT frag_id, min(CAST(floor(before / {target}) AS INT)) AS grp FROM placed GROUP BY frag_id
"""


def whole(value: object) -> int | None:
    """A file_size as a whole number, however it is written."""
    if isinstance(value, bool) or not isinstance(value, (int, str, Decimal)):
        return None
    try:
        number = Decimal(value.strip() if isinstance(value, str) else value)
        if not number.is_finite() or number.adjusted() > 18 or number != number.to_integral_value():
            return None
    except InvalidOperation:
        return None
    return int(number) if -(2**63) <= number < 2**63 else None


def records(body: str | None) -> list[tuple[str, int]]:
    """(path, file_size) of each complete record: single objects, lines, arrays, maps by path; a part cut off is left out."""
    found: list[tuple[str, int]] = []

    def closed(pairs: list) -> dict:
        # called as each object closes, so that those within a broken array or map count too
        d = dict(pairs)
        if isinstance(d.get("path"), str) and (n := whole(d.get("file_size"))) is not None:
            found.append((d["path"].encode("utf-8", "replace").decode("utf-8"), n))
        return d

    decoder = json.JSONDecoder(object_pairs_hook=closed, parse_float=Decimal, strict=False)
    at, body = 0, body or ""
    while m := _START.search(body, at):
        try:
            _, at = decoder.raw_decode(body, m.start())
        except (ValueError, RecursionError):
            at = body.find("\n", m.start()) + 1  # what comes after a broken line counts again
            if not at:
                break
    return found


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups, bodies = (c.to_pylist() for c in batch.columns)
        first: dict[tuple[str, int], int] = {}
        for g, body in zip(groups, bodies):
            for r in records(body):
                first[r] = min(g, first.get(r, g))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in first], pa.string()), pa.array([r[1] for r in first], pa.int64()), pa.array(list(first.values()), pa.int32())],
            ["path", "file_size", "grp"],
        )


def plan_groups(spark: SparkSession, manifest: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """(frag_id, grp) for the frozen manifest of (frag_id, frag_path, bytes, bucket). No window spans the whole manifest: the bytes before a
    fragment are those before its chunk of buckets, its bucket, and itself."""
    return spark.sql(PLAN.format(manifest="{manifest}", target=int(target_bytes)), manifest=manifest)


def consolidate(spark: SparkSession, fragments: DataFrame, out: str, target_bytes: int = TARGET_BYTES, frozen: str | None = None) -> DataFrame:
    """Writes the complete records of the fragments to `out`, one file for each group, and gives the written table back.

    Raises if what is read back differs from what was parsed in the number or the sum of hashes of the records.
    """
    frozen = frozen or own_folder(spark, "manifest")
    size = F.when(F.col("frag_size") >= 0, F.col("frag_size")).otherwise(F.coalesce(F.octet_length("body"), F.lit(0))).cast("bigint")
    fragments.select("frag_id", "frag_path", size.alias("bytes"), F.floor(F.coalesce("frag_id", F.lit(0)) / BUCKET).alias("bucket")).write.parquet(frozen)
    groups = plan_groups(spark, spark.read.parquet(frozen), target_bytes)
    bodies = fragments.select("frag_id", "body").where("body <> ''")
    parsed = bodies.join(groups, bodies.frag_id.eqNullSafe(groups.frag_id)).select("grp", "body").mapInArrow(_parse, "path string, file_size bigint, grp int")
    kept = parsed.groupBy("path", "file_size").agg(F.min("grp").alias("grp"))
    noted = own_folder(spark, "records")
    kept.write.parquet(noted)
    kept = spark.read.parquet(noted)
    check = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "file_size").cast("decimal(38,0)")).alias("h"), F.max("grp").alias("g")).first()
    said = check(kept)
    if said.n:
        n = said.g + 1
        kept.repartitionById(n, "grp").sortWithinPartitions("path", "file_size").write.parquet(out)
    else:
        kept.write.parquet(out)
    there = spark.read.schema("path string, file_size bigint, grp int").parquet(out)
    if (said.n, said.h) != tuple(check(there))[:2]:
        raise RuntimeError(f"{out} holds other records than were parsed")
    return there.select("path", "file_size")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that the consolidated files hold, read from these files."""
    fragments = table(spark, sf_dir, "manifest_fragments").select("frag_id", "frag_path", "frag_size", "body")
    return consolidate(spark, fragments, own_folder(spark, "consolidated"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan alone: (frag_id, grp) for a target of 1 MB."""
    fragments = table(spark, sf_dir, "manifest_fragments").select("frag_id", "frag_path", F.col("frag_size").alias("bytes"), F.floor(F.col("frag_id") / BUCKET).alias("bucket"))
    return plan_groups(spark, fragments, 1 << 20)


#: An object without objects in it; braces within texts don't count.
_OBJECT = r"""\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}"""

SQL = {
    "p4_found": f"""
WITH o AS (SELECT unnest(regexp_extract_all(body, '{_OBJECT}')) AS o FROM manifest_fragments),
v AS (SELECT o::JSON AS o FROM o WHERE json_valid(o)),
r AS (SELECT json_extract_string(o, '$.path') AS path, trim(json_extract_string(o, '$.file_size')) AS n FROM v WHERE json_type(o, '$.path') = 'VARCHAR' AND json_type(o, '$.file_size') NOT IN ('NULL', 'BOOLEAN', 'ARRAY', 'OBJECT'))
SELECT DISTINCT path, CAST(CAST(n AS DOUBLE) AS BIGINT) AS file_size FROM r WHERE try_cast(n AS DOUBLE) = floor(try_cast(n AS DOUBLE))""",
    "p4_groups": """
SELECT frag_id, CAST(floor(coalesce(sum(frag_size) OVER (ORDER BY frag_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1048576) AS INT) AS grp FROM manifest_fragments"""
}
QUERIES = {"p4_found": p4_found, "p4_groups": groups}
