"""Plane transforms and boxes that bring one image onto another."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def affine(points: np.ndarray) -> np.ndarray:
    """Least-squares affine map of rows ``(x, y, u, v)`` as a 3x3 matrix."""
    a = np.column_stack([points[:, :2], np.ones(len(points))])
    m, *_ = np.linalg.lstsq(a, points[:, 2:4], rcond=None)
    return np.vstack([m.T, [0.0, 0.0, 1.0]])


def homography(points: np.ndarray) -> np.ndarray:
    """Projective map of at least four rows ``(x, y, u, v)``: the null direction of the linear system, last entry 1."""
    x, y, u, v = points.T
    one, zero = np.ones_like(x), np.zeros_like(x)
    top = np.column_stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u])
    low = np.column_stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v])
    h = np.linalg.svd(np.vstack([top, low]))[2][-1].reshape(3, 3)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def residuals(matrix: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = matrix @ np.column_stack([points[:, :2], np.ones(len(points))]).T
    return np.hypot(*(p[:2] / p[2] - points[:, 2:4].T))


def fit(points: DataFrame, key: str, kind: str = "affine") -> DataFrame:
    """Per key the fitted matrix (row by row) and the residuals' mean, maximum and root mean square.

    ``points`` have ``x, y, u, v``; rows with a missing number are left out, keys with fewer than 3 (affine)
    or 4 points have no row. A key's control points are few and meet in one task.
    """
    solve, least = (affine, 3) if kind == "affine" else (homography, 4)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y", "u", "v"]].to_numpy(dtype=float)
        if len(p) < least:
            return pd.DataFrame(columns=[key, "matrix", "mean", "max", "rmse"], dtype=object)
        m = solve(p)
        r = residuals(m, p)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "matrix": [m.ravel().tolist()], "mean": [r.mean()], "max": [r.max()], "rmse": [np.sqrt((r * r).mean())]})

    ok = points.select(key, *[F.col(c).cast("double").alias(c) for c in "xyuv"]).na.drop()
    return ok.groupBy(key).applyInPandas(run, f"`{key}` {points.schema[key].dataType.simpleString()}, matrix array<double>, mean double, max double, rmse double")


def clamped_box(x: Column, y: Column, width: Column, height: Column, image: tuple[int, int]) -> Column:
    """The box moved and cut into the image, at least one pixel wide and high, as integers ``x0, y0, x1, y1``."""
    w = F.greatest(F.lit(1.0), F.least(width, F.lit(float(image[0]))))
    h = F.greatest(F.lit(1.0), F.least(height, F.lit(float(image[1]))))
    left = F.greatest(F.lit(0.0), F.least(x, image[0] - w))
    top = F.greatest(F.lit(0.0), F.least(y, image[1] - h))
    whole = lambda c: F.bround(c).cast("int")
    x0, y0 = whole(left), whole(top)
    end = lambda a, n, most: F.greatest(a + 1, F.least(whole(n), F.lit(most)))
    return F.struct(x0.alias("x0"), y0.alias("y0"), end(x0, left + w, image[0]).alias("x1"), end(y0, top + h, image[1]).alias("y1"))
