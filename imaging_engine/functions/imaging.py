"""Pixels, windows, positions and planes of image slices as expressions over arrays.

The slices of the queries are the embeddings as images of 8 by 8 pixels, a series for each label, with positions made of their ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imaging_engine.shared import table

TINY = 1e-6
LEAST_SPACING = 0.001
LEAST_AXIS_SPACING = 0.125


def at(a: Column, k: int) -> Column:
    return a.getItem(k)


def dot(a: Column, b: Column) -> Column:
    return sum((at(a, k) * at(b, k) for k in range(1, 3)), at(a, 0) * at(b, 0))


def cross(a: Column, b: Column) -> Column:
    return F.array(*[at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


def add(a: Column, b: Column) -> Column:
    return F.array(*[at(a, k) + at(b, k) for k in range(3)])


def sub(a: Column, b: Column) -> Column:
    return F.array(*[at(a, k) - at(b, k) for k in range(3)])


def scale(a: Column, x: Column) -> Column:
    return F.array(*[at(a, k) * x for k in range(3)])


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Of length one; null where the vector is tiny."""
    m = magnitude(a)
    return F.when(m > TINY, F.array(*[at(a, k) / m for k in range(3)]))


def numbers(text: Column, least: int) -> Column:
    """The numbers of a text parted by backslashes; null where there are fewer than least."""
    a = F.array_compact(F.transform(F.split(text, r"\\"), lambda v: F.trim(v).try_cast("double")))
    return F.when(F.size(a) >= least, a)


def rescaled(px: Column, slope: Column, intercept: Column) -> Column:
    return F.transform(px, lambda v: v * F.coalesce(slope, F.lit(1.0)) + F.coalesce(intercept, F.lit(0.0)))


def windowed(px: Column, center: Column, width: Column) -> Column:
    """Linear from 0 to 255 within the window."""
    lo = center - width / 2
    span = F.greatest((center + width / 2) - lo, F.lit(1.1920928955078125e-07))
    return F.transform(px, lambda v: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - lo) / span)) * 255).cast("int"))


def lut_windowed(px: Column, center: Column, width: Column) -> Column:
    """As the standard's lookup has it: half a step off at either side."""
    c = center - 0.5
    w = width - 1
    return F.transform(px, lambda v: F.when(v <= c - w / 2, 0).when(v > c + w / 2, 255).otherwise(F.floor(((v - c) / w + 0.5) * 255).cast("int")))


def thumbnail(px: Column, width: int, height: int, most: int) -> Column:
    """Nearest pixels at the centres of a smaller image; never larger than the image."""
    s = min(1.0, most / max(width, height))
    w, h = max(1, round(width * s)), max(1, round(height * s))
    picks = [min(height - 1, int((y + 0.5) * height / h)) * width + min(width - 1, int((x + 0.5) * width / w)) for y in range(h) for x in range(w)]
    return F.array(*[px.getItem(k) for k in picks])


def default_window(lo: Column, hi: Column, center: Column, width: Column) -> tuple[Column, Column]:
    """The given window where both its numbers are there, else that of the values."""
    given = center.isNotNull() & width.isNotNull()
    return F.when(given, center).otherwise((lo + hi) / 2), F.when(given, width).otherwise(F.greatest(hi - lo, F.lit(1.0)))


def slice_position(position: Column, orientation: Column, instance: Column) -> Column:
    """Along the normal of the slice; the instance number, or 0, where there is no normal."""
    normal = cross(F.slice(orientation, 1, 3), F.slice(orientation, 4, 3))
    projected = F.when(magnitude(normal) > TINY, dot(position, normal) / magnitude(normal))
    return F.coalesce(projected, instance.cast("double"), F.lit(0.0))


def physical_size(pixels: int, spacing: Column) -> Column:
    return F.when(spacing.isNull(), F.lit(float(pixels))).otherwise(pixels * F.greatest(F.abs(spacing), F.lit(LEAST_SPACING)))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, series, instance, file, px, position, orientation, spacing): every ninth slice lacks orientation, every seventh its instance number."""
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id").cast("double")
    z = F.array(F.lit(0.0), F.lit(0.0), i * 0.5 + (F.col("vec_id") % 3) * 0.125)
    o = F.when(F.col("vec_id") % 9 != 0, F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0)]))
    return e.select(
        "vec_id", F.col("label").cast("bigint").alias("series"), F.when(F.col("vec_id") % 7 != 0, F.col("vec_id")).alias("instance"), F.format_string("IMG_%05d.dcm", "vec_id").alias("file"),
        F.transform("embedding", lambda v: v.cast("double")).alias("px"), z.alias("position"), o.alias("orientation"), F.lit(0.5).alias("spacing"),
    )


_S = """s AS (SELECT vec_id, CAST(label AS BIGINT) AS series, CASE WHEN vec_id % 7 <> 0 THEN vec_id END AS instance, printf('IMG_%05d.dcm', vec_id) AS file, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS px,
 vec_id * 0.5::DOUBLE + (vec_id % 3) * 0.125::DOUBLE AS z, vec_id % 9 <> 0 AS oriented FROM embeddings),
p AS (SELECT *, CASE WHEN oriented THEN z ELSE coalesce(CAST(instance AS DOUBLE), 0) END AS pos FROM s)"""


def _summed(name: str, px: Column) -> list[Column]:
    """An array told by its sum and its places, so that it can be compared as numbers."""
    total = F.aggregate(px, F.lit(0.0).cast("double"), lambda s, v: s + v)
    placed = F.aggregate(F.zip_with(px, F.sequence(F.lit(1), F.size(px)), lambda v, k: v * k), F.lit(0.0).cast("double"), lambda s, v: s + v)
    return [F.round(total, 4).alias(f"{name}_sum"), F.round(placed, 3).alias(f"{name}_placed")]


def mth01_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices(spark, sf_dir).select("vec_id", *_summed("px", rescaled(F.col("px"), F.lit(2.0), F.when(F.col("vec_id") % 2 == 0, F.lit(-4.0)))))


def mth02_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices(spark, sf_dir).select("vec_id", *_summed("gray", windowed(F.col("px"), F.lit(0.0), F.lit(0.25))))


def mth03_lut_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices(spark, sf_dir).select("vec_id", *_summed("gray", lut_windowed(rescaled(F.col("px"), F.lit(1000.0), F.lit(0.0)), F.lit(40.0), F.lit(400.0))))


def mth04_thumbnail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices(spark, sf_dir).select("vec_id", *_summed("px", thumbnail(F.col("px"), 8, 8, 3)))


def mth05_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the algebra on the first six pixels of each image."""
    a, b = F.slice("px", 1, 3), F.slice("px", 4, 3)
    n = normalize(cross(a, b))
    moved = sub(add(a, scale(b, F.lit(2.0))), b)
    return slices(spark, sf_dir).select("vec_id", F.round(dot(a, b), 6).alias("dot"), F.round(magnitude(cross(a, b)), 6).alias("area"), F.round(at(n, 2), 4).alias("normal_z"), F.round(magnitude(moved), 6).alias("moved"))


def mth06_slice_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices(spark, sf_dir).select("vec_id", F.round(slice_position(F.col("position"), F.col("orientation"), F.col("instance")), 6).alias("at"))


def mth07_physical_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("vec_id") % 2 == 0, at(F.col("px"), 0) / 100)
    return slices(spark, sf_dir).select("vec_id", F.round(physical_size(8, s), 6).alias("size"))


def arr01_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacings and positions given as one text."""
    from imaging_engine.functions.deid import elements

    a = numbers(F.regexp_replace("value", ",", "."), 2)
    return elements(spark, sf_dir).where("tag IN ('0028,0030', '0018,0050', '0020,1041')").select("file", "tag", F.coalesce(F.size(a), F.lit(0)).cast("bigint").alias("n"), F.round(at(a, 0), 6).alias("first"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices(spark, sf_dir).withColumn("pos", slice_position(F.col("position"), F.col("orientation"), F.col("instance")))


def _in_order() -> Window:
    return Window.partitionBy("series").orderBy("pos", F.col("instance").asc_nulls_first(), "file")


def agg13_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, w = default_window(F.array_min("px"), F.array_max("px"), F.when(F.col("vec_id") % 5 == 0, F.lit(40.0)), F.lit(400.0))
    return slices(spark, sf_dir).select("vec_id", F.round(c, 6).alias("center"), F.round(w, 6).alias("width"))


def gaps(rows: DataFrame) -> DataFrame:
    """Each slice with the distance to the one before it."""
    return rows.withColumn("gap", F.abs(F.col("pos") - F.lag("pos").over(_in_order())))


def agg14_mean_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean distance of slices that are apart at all; the given spacing where none is."""
    g = gaps(placed(spark, sf_dir)).groupBy("series").agg(F.avg(F.when(F.col("gap") > 1e-3, F.col("gap"))).alias("m"), F.min("spacing").alias("s"))
    return g.select("series", F.round(F.coalesce("m", "s", F.lit(1.0)), 6).alias("gap"))


def agg15_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around all corners of a series' slices: eight pixels at their spacing, at their positions."""
    corners = F.array(*[F.array(F.lit(x) * F.col("spacing"), F.lit(y) * F.col("spacing"), at(F.col("position"), 2)) for x in (0.0, 7.0) for y in (0.0, 7.0)])
    c = slices(spark, sf_dir).select("series", F.explode(corners).alias("c"))
    ends = [f(at(F.col("c"), k)).alias(f"{n}_{a}") for k, a in enumerate("xyz") for f, n in ((F.min, "min"), (F.max, "max"))]
    return c.groupBy("series").agg(*ends)


def axis_spacing(candidates: Column) -> Column:
    """The least that is more than an eighth; where none is, the least of all, but an eighth at least."""
    good = F.filter(candidates, lambda x: x > LEAST_AXIS_SPACING)
    return F.when(F.size(good) > 0, F.array_min(good)).otherwise(F.greatest(F.array_min(candidates), F.lit(LEAST_AXIS_SPACING)))


def agg16_axis_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices(spark, sf_dir).select("vec_id", F.round(axis_spacing(F.transform(F.slice("px", 1, 3), lambda v: F.abs(v))), 6).alias("spacing"))


def win01_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step of a series that moves at all."""
    step = F.col("pos") - F.lag("pos").over(_in_order())
    rows = placed(spark, sf_dir).withColumn("n", F.row_number().over(_in_order())).withColumn("step", step)
    return rows.where(F.abs("step") > TINY).groupBy("series").agg(F.round(F.min_by("step", "n"), 6).alias("step"))


def win02_relative_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 0 to 1 along the series; by number where all positions are one."""
    w = Window.partitionBy("series")
    lo, hi, n = F.min("pos").over(w), F.max("pos").over(w), F.count(F.lit(1)).over(w)
    rank = F.row_number().over(_in_order()) - 1
    flat = F.when(n == 1, F.lit(0.5)).otherwise(rank / (n - 1))
    at_ = F.when(hi - lo > TINY, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("pos") - lo) / (hi - lo)))).otherwise(flat)
    return placed(spark, sf_dir).select("vec_id", F.round(at_, 6).alias("at"))


def srt02_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each image in its series: by instance number, missing ones first, then by file."""
    w = Window.partitionBy("series").orderBy(F.col("instance").asc_nulls_first(), "file")
    return slices(spark, sf_dir).select("vec_id", F.row_number().over(w).cast("bigint").alias("n"))


def srt03_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("vec_id", F.row_number().over(_in_order()).cast("bigint").alias("n"))


def srt04_by_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending by instance number; as they came where any of the series lacks it."""
    w = Window.partitionBy("series")
    lacking = F.count_if(F.col("instance").isNull()).over(w) > 0
    keyed = slices(spark, sf_dir).withColumn("k", F.when(lacking, F.col("vec_id")).otherwise(-F.col("instance")))
    return keyed.select("vec_id", F.row_number().over(Window.partitionBy("series").orderBy("k", "vec_id")).cast("bigint").alias("n"))


def srt05_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices(spark, sf_dir).select("vec_id", at(F.col("position"), 2).alias("location")).orderBy("location", "vec_id")


def with_plane_line(rows: DataFrame, n1: str, p1: str, n2: str, p2: str) -> DataFrame:
    """Adds the point and the direction of the line in which two planes (normal, point) meet; null where they are parallel. In steps, each a
    column of its own, so that no expression is written out again and again."""
    c = F.col
    rows = rows.withColumn("line_d", cross(c(n1), c(n2)))
    rows = rows.withColumns({"line_dd": dot(c("line_d"), c("line_d")), "line_a": cross(c(n2), c("line_d")), "line_b": cross(c("line_d"), c(n1)), "line_x": dot(c(n1), c(p1)), "line_y": dot(c(n2), c(p2))})
    point = F.array(*[(at(c("line_a"), k) * c("line_x") + at(c("line_b"), k) * c("line_y")) / c("line_dd") for k in range(3)])
    apart = F.sqrt("line_dd") > TINY
    rows = rows.withColumns({"line_point": F.when(apart, point), "line_direction": F.when(apart, normalize(c("line_d")))})
    return rows.drop("line_d", "line_dd", "line_a", "line_b", "line_x", "line_y")


def mth11_plane_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the plane of a slice meets that of the next one of its series, with pixels as normals and positions."""
    cut = {"n1": F.slice("a.px", 1, 3), "n2": F.slice("b.px", 1, 3), "p1": F.slice("a.px", 4, 3), "p2": F.slice("b.px", 4, 3)}
    pairs = neighbours(slices(spark, sf_dir)).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), *[v.alias(k) for k, v in cut.items()])
    lines = with_plane_line(pairs, "n1", "p1", "n2", "p2")
    off = lambda n, p: F.round(F.abs(dot(F.col(n), sub(F.col("line_point"), F.col(p)))), 4)
    return lines.select("a", "b", off("n1", "p1").alias("on_first"), off("n2", "p2").alias("on_second"), F.round(magnitude(F.col("line_direction")), 4).alias("length"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Each slice and the next of its series: pairs in number of the slices, not all pairs of a series."""
    n = rows.withColumn("n", F.row_number().over(Window.partitionBy("series").orderBy("vec_id")))
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.series") == F.col("b.series")) & (F.col("a.n") + 1 == F.col("b.n")))


def joi14_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of viewports of one study: the caller shows few, here four of each series at most (the layout is the bound)."""
    w = Window.partitionBy("series").orderBy("vec_id")
    shown = slices(spark, sf_dir).select("series", "vec_id", F.row_number().over(w).alias("n")).where("n <= 4")
    a, b = shown.alias("a"), shown.alias("b")
    return a.join(b, (F.col("a.series") == F.col("b.series")) & (F.col("a.n") < F.col("b.n"))).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"))


def prj09_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry as a panel shows it."""
    p = F.col("position")
    return slices(spark, sf_dir).select("vec_id", F.format_string("%.4f \\ %.4f \\ %.4f", at(p, 0), at(p, 1), at(p, 2)).alias("position"), F.format_string("%.6f", "spacing").alias("spacing"))


def agg22_legacy_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD5 of the pixel values as text, with commas between them."""
    ints = F.transform("px", lambda v: F.floor(v * 1000).cast("string"))
    return slices(spark, sf_dir).select("vec_id", F.md5(F.array_join(ints, ",")).alias("digest"))


def _sql_summed(name: str, px: str) -> str:
    return f"round(CAST(list_sum({px}) AS DOUBLE), 4) AS {name}_sum, round(CAST(list_sum(list_transform({px}, lambda v, k: v * k)) AS DOUBLE), 3) AS {name}_placed"


_DOT = "(px[1] * px[4] + px[2] * px[5] + px[3] * px[6])"
_CX, _CY, _CZ = "(px[2] * px[6] - px[3] * px[5])", "(px[3] * px[4] - px[1] * px[6])", "(px[1] * px[5] - px[2] * px[4])"
_AREA = f"sqrt({_CX} * {_CX} + {_CY} * {_CY} + {_CZ} * {_CZ})"
_ORD = "PARTITION BY series ORDER BY pos, instance NULLS FIRST, file"
_THUMB = "[" + ", ".join(f"px[{min(7, int((y + 0.5) * 8 / 3)) * 8 + min(7, int((x + 0.5) * 8 / 3)) + 1}]" for y in range(3) for x in range(3)) + "]"
_GRAY = "list_transform(px, lambda v: CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (v + 0.125) / 0.25)) * 255) AS INTEGER))"
_LUT = "list_transform(list_transform(px, lambda v: v * 1000 + 0), lambda v: CASE WHEN v <= 39.5 - 199.5 THEN 0 WHEN v > 39.5 + 199.5 THEN 255 ELSE CAST(floor(((v - 39.5) / 399 + 0.5) * 255) AS INTEGER) END)"

SQL = {
    "mth01_rescale": f"WITH {_S} SELECT vec_id, {_sql_summed('px', 'list_transform(px, lambda v: v * 2 + CASE WHEN vec_id % 2 = 0 THEN -4 ELSE 0 END)')} FROM s",
    "mth02_window": f"WITH {_S} SELECT vec_id, {_sql_summed('gray', _GRAY)} FROM s",
    "mth03_lut_window": f"WITH {_S} SELECT vec_id, {_sql_summed('gray', _LUT)} FROM s",
    "mth04_thumbnail": f"WITH {_S} SELECT vec_id, {_sql_summed('px', _THUMB)} FROM s",
    "mth05_vectors": f"WITH {_S} SELECT vec_id, round({_DOT}, 6) AS dot, round({_AREA}, 6) AS area, round(CASE WHEN {_AREA} > 1e-6 THEN {_CZ} / {_AREA} END, 4) AS normal_z, round(sqrt(power(px[1] + px[4], 2) + power(px[2] + px[5], 2) + power(px[3] + px[6], 2)), 6) AS moved FROM s",
    "mth06_slice_position": f"WITH {_S} SELECT vec_id, round(pos, 6) AS at FROM p",
    "mth07_physical_size": f"WITH {_S} SELECT vec_id, round(CASE WHEN vec_id % 2 = 0 THEN 8 * greatest(abs(px[1] / 100), 0.001) ELSE 8.0 END::DOUBLE, 6) AS size FROM s",
    "agg13_window": f"WITH {_S} SELECT vec_id, round(CASE WHEN vec_id % 5 = 0 THEN 40.0::DOUBLE ELSE (list_min(px) + list_max(px)) / 2 END, 6) AS center, round(CASE WHEN vec_id % 5 = 0 THEN 400.0::DOUBLE ELSE greatest(list_max(px) - list_min(px), 1.0) END, 6) AS width FROM s",
    "agg14_mean_gap": f"WITH {_S}, g AS (SELECT series, abs(pos - lag(pos) OVER ({_ORD})) AS gap FROM p) SELECT series, round(coalesce(avg(CASE WHEN gap > 1e-3 THEN gap END), 0.5), 6) AS gap FROM g GROUP BY 1",
    "agg15_bounding_box": f"WITH {_S} SELECT series, 0.0::DOUBLE AS min_x, 3.5::DOUBLE AS max_x, 0.0::DOUBLE AS min_y, 3.5::DOUBLE AS max_y, min(z) AS min_z, max(z) AS max_z FROM s GROUP BY 1",
    "agg16_axis_spacing": f"WITH {_S}, a AS (SELECT vec_id, [abs(px[1]), abs(px[2]), abs(px[3])] AS c FROM s) SELECT vec_id, round(coalesce(list_min(list_filter(c, lambda x: x > 0.125)), greatest(list_min(c), 0.125)), 6) AS spacing FROM a",
    "win01_direction": f"WITH {_S}, g AS (SELECT series, pos - lag(pos) OVER ({_ORD}) AS step, row_number() OVER ({_ORD}) AS n FROM p) SELECT series, round(arg_min(step, n), 6) AS step FROM g WHERE abs(step) > 1e-6 GROUP BY 1",
    "win02_relative_position": f"WITH {_S}, w AS (SELECT vec_id, pos, min(pos) OVER (PARTITION BY series) AS lo, max(pos) OVER (PARTITION BY series) AS hi, count(*) OVER (PARTITION BY series) AS n, row_number() OVER ({_ORD}) - 1 AS r FROM p) SELECT vec_id, round(CASE WHEN hi - lo > 1e-6 THEN (pos - lo) / (hi - lo) WHEN n = 1 THEN 0.5 ELSE r / (n - 1) END::DOUBLE, 6) AS at FROM w",
    "srt02_images": f"WITH {_S} SELECT vec_id, row_number() OVER (PARTITION BY series ORDER BY instance NULLS FIRST, file) AS n FROM s",
    "srt03_slices": f"WITH {_S} SELECT vec_id, row_number() OVER ({_ORD}) AS n FROM p",
    "srt04_by_attribute": f"WITH {_S}, k AS (SELECT vec_id, series, CASE WHEN count(*) FILTER (WHERE instance IS NULL) OVER (PARTITION BY series) > 0 THEN vec_id ELSE -instance END AS k FROM s) SELECT vec_id, row_number() OVER (PARTITION BY series ORDER BY k, vec_id) AS n FROM k",
    "srt05_by_location": f"WITH {_S} SELECT vec_id, z AS location FROM s ORDER BY 2, 1",
    "mth11_plane_lines": f"WITH {_S}, n AS (SELECT series, vec_id, px, row_number() OVER (PARTITION BY series ORDER BY vec_id) AS n FROM s) SELECT a.vec_id AS a, b.vec_id AS b, 0.0::DOUBLE AS on_first, 0.0::DOUBLE AS on_second, 1.0::DOUBLE AS length FROM n a JOIN n b ON a.series = b.series AND a.n + 1 = b.n",
    "joi14_pairs": f"WITH {_S}, n AS (SELECT series, vec_id, row_number() OVER (PARTITION BY series ORDER BY vec_id) AS n FROM s) SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.series = b.series AND a.n < b.n AND b.n <= 4",
    "prj09_panel": f"WITH {_S} SELECT vec_id, printf('%.4f \\ %.4f \\ %.4f', 0.0::DOUBLE, 0.0::DOUBLE, z) AS position, '0.500000' AS spacing FROM s",
    "agg22_legacy_digest": f"WITH {_S} SELECT vec_id, md5(array_to_string(list_transform(px, lambda v: CAST(CAST(floor(v * 1000) AS BIGINT) AS VARCHAR)), ',')) AS digest FROM s",
}
QUERIES = {name: globals()[name] for name in SQL} | {"arr01_numbers": arr01_numbers}
