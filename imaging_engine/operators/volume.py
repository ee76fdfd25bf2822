"""Slices of a series as a volume, and planes through it along the patient's axes.

A volume is assembled in one task: an acquisition is bounded by its scanner, unlike the keys of other operators. What is wrong with a series is a
status, never a failed job.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLANES = {"axial": (0, 1, 2), "coronal": (0, 2, 1), "sagittal": (1, 2, 0)}
SCHEMA = "series_uid string, status string, plane string, idx int, width int, height int, pixels array<double>"


@dataclass
class Volume:
    data: np.ndarray  # slice, row, column
    origin: np.ndarray
    steps: np.ndarray  # unit vectors of column, row and slice
    spacing: np.ndarray  # of column, row and slice
    window: tuple[float, float]

    @property
    def corners(self) -> tuple[np.ndarray, np.ndarray]:
        depth, height, width = self.data.shape
        ends = np.array([width - 1, height - 1, depth - 1])
        picks = np.array(np.meshgrid(*[(0, 1)] * 3)).reshape(3, -1).T * ends
        points = self.origin + picks * self.spacing @ self.steps
        return points.min(0), points.max(0)

    def axis_spacing(self, axis: int) -> float:
        candidates = self.spacing * np.abs(self.steps[:, axis])
        good = candidates[candidates > 0.125]
        return float(good.min()) if len(good) else max(float(self.spacing.min()), 0.125)

    def coordinates(self, axis: int) -> np.ndarray:
        lo, hi = self.corners
        step = self.axis_spacing(axis)
        n = max(1, int(np.floor((hi[axis] - lo[axis]) / step + 0.5)) + 1)
        return np.minimum(lo[axis] + np.arange(n) * step, hi[axis])

    def sample(self, points: np.ndarray) -> np.ndarray:
        """Between the eight voxels around each point; the least value outside."""
        at = (points - self.origin) @ self.steps.T / self.spacing
        last = np.array(self.data.shape[::-1]) - 1
        inside = ((at >= 0) & (at <= last)).all(-1)
        at = np.clip(at, 0, last)
        low = np.floor(at).astype(int)
        part, high = at - low, np.minimum(low + 1, last)
        out = np.zeros(at.shape[:-1])
        for corner in range(8):
            pick = [(corner >> k) & 1 for k in range(3)]
            where = [np.where(p, high[..., k], low[..., k]) for k, p in enumerate(pick)]
            weight = np.prod([part[..., k] if p else 1 - part[..., k] for k, p in enumerate(pick)], axis=0)
            out += weight * self.data[where[2], where[1], where[0]]
        return np.where(inside, out, self.data.min())

    def plane(self, name: str, index: int) -> np.ndarray:
        u, v, w = PLANES[name]
        us, vs, ws = (self.coordinates(a) for a in (u, v, w))
        points = np.zeros((len(vs), len(us), 3))
        points[..., u], points[..., v], points[..., w] = us[None, :], vs[:, None], ws[min(index, len(ws) - 1)]
        return self.sample(points)


def _unit(v) -> np.ndarray | None:
    n = np.linalg.norm(v)
    return np.asarray(v, float) / n if n > 1e-6 else None


def _there(v) -> bool:
    return v is not None and not (np.isscalar(v) and pd.isna(v))


def assemble(rows: pd.DataFrame) -> Volume | str:
    """The volume of the slices (filename, instance, w, h, channels, pixels, spacing, thickness, position, orientation), or what is wrong with them."""
    if len(rows) < 2:
        return "at least 2 slices are needed"
    if (rows.channels != 1).any():
        return "only grayscale series have a volume"
    if not rows.orientation.map(_there).all():
        return "every slice needs an orientation"
    if not rows.position.map(_there).all():
        return "every slice needs a position"
    axes = [(_unit(o[:3]), _unit(o[3:6])) for o in rows.orientation]
    if any(a is None or b is None for a, b in axes):
        return "an orientation has no direction"
    column, row = axes[0]
    if abs(column @ row) > 1e-3:
        return "the orientation is not orthogonal"
    if any(a @ column < 0.999 or b @ row < 0.999 for a, b in axes):
        return "the orientation is not consistent"
    if rows.w.nunique() > 1 or rows.h.nunique() > 1:
        return "the dimensions are not identical"
    given = [np.asarray(s, float) for s in rows.spacing if _there(s)]
    between = given[0] if given else np.ones(2)
    if any(np.abs(s - between).max() >= 1e-3 for s in given):
        return "the pixel spacing is not consistent"
    normal = np.cross(column, row)
    rows = rows.assign(at=[float(normal @ np.asarray(p, float)) for p in rows.position], i=rows.instance.fillna(-np.inf)).sort_values(["at", "i", "filename"])
    data = np.stack([np.asarray(p, float).reshape(h, w) for p, h, w in zip(rows.pixels, rows.h, rows.w)])
    positions = np.stack([np.asarray(p, float) for p in rows.position])
    moves = [m for m in map(_unit, np.diff(positions, axis=0)) if m is not None]
    gaps = np.abs(np.diff(rows["at"].to_numpy()))
    gaps = gaps[gaps > 1e-3]
    thickness = next((float(t) for t in rows.thickness if _there(t)), 1.0)
    step = float(gaps.mean()) if len(gaps) else abs(thickness)
    spacing = np.maximum(np.abs([between[1], between[0], step]), 0.001)
    lo, hi = float(data.min()), float(data.max())
    return Volume(data, positions[0], np.stack([column, row, moves[0] if moves else normal]), spacing, ((lo + hi) / 2, max(hi - lo, 1.0)))


def planes(slices: DataFrame, plane: str = "axial", index: int | None = None) -> DataFrame:
    """For each series_uid the plane at the index (the middle one by default), or the status that tells why there is none."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        uid, v = rows.series_uid.iloc[0], assemble(rows)
        if isinstance(v, str):
            return pd.DataFrame([(uid, v, plane, None, None, None, None)], columns=[c.split()[0] for c in SCHEMA.split(", ")])
        k = len(v.coordinates(PLANES[plane][2])) // 2 if index is None else index
        p = v.plane(plane, k)
        return pd.DataFrame([(uid, "ok", plane, k, p.shape[1], p.shape[0], p.ravel().tolist())], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return slices.groupBy("series_uid").applyInPandas(one, SCHEMA)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen consecutive embeddings are a series of slices of 8 by 8 pixels."""
    from imaging_engine.functions.imaging import slices

    s = slices(spark, sf_dir)
    return s.select(
        F.floor(F.col("vec_id") / 16).cast("string").alias("series_uid"), F.col("file").alias("filename"), F.col("instance").cast("double").alias("instance"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(1).alias("channels"), F.col("px").alias("pixels"),
        F.array(F.lit(0.5), F.lit(0.5)).alias("spacing"), F.lit(1.0).alias("thickness"), "position", F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0)]).alias("orientation"),
    )


def _query(plane: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return planes(_series(spark, sf_dir), plane).withColumn("pixels", F.array_join(F.transform("pixels", lambda v: F.format_string("%.4f", v)), " "))

    return run


QUERIES = {f"mth10_{p}_plane": _query(p) for p in PLANES}
