"""Checks of grids, layers and samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def ledger(df: DataFrame, checks: dict[str, Column], warnings: Sequence[str] = ()) -> DataFrame:
    """``check, n_violations, status`` of each condition that a row must not meet: PASS, else WARN or FAIL."""
    counts = df.agg(*[F.count_if(c).alias(name) for name, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("n_violations"), F.lit("WARN" if name in warnings else "FAIL").alias("bad")) for name in checks])
    out = counts.select(F.explode(rows).alias("r")).select("r.*")
    return out.select("check", "n_violations", F.when(F.col("n_violations") == 0, "PASS").otherwise(F.col("bad")).alias("status"))


def grid_completeness(pixels: DataFrame, image: str, row: str, col: str, width: int | None = None) -> DataFrame:
    """Per image the pixels, distinct positions, expected positions (by largest row and column, or ``width``) and what is wrong."""
    at = F.struct(row, col)
    g = pixels.groupBy(image).agg(F.count("*").alias("n"), F.count_distinct(at).alias("n_distinct"), (F.max(row) + 1).alias("__h"), (F.lit(width) if width else F.max(col) + 1).alias("__w"), F.count_if((F.col(row) < 0) | (F.col(col) < 0)).alias("n_negative"))
    g = g.withColumn("expected", F.col("__h").cast("long") * F.col("__w"))
    state = F.when(F.col("n_negative") > 0, "negative").when(F.col("n") > F.col("n_distinct"), "duplicates").when(F.col("n_distinct") < F.col("expected"), "incomplete").otherwise("complete")
    return g.select(image, "n", "n_distinct", "expected", state.alias("state"))


def edge(row: Column, col: Column, height: int, width: int, border: int = 5) -> Column:
    return (row < border) | (row >= height - border) | (col < border) | (col >= width - border)


def _components(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Label of each pixel: 8-connected neighbours share one. Smallest labels spread and are shortened until nothing changes."""
    if not len(rows):
        return np.zeros(0, dtype="int64")
    h, w = rows.max() + 3, cols.max() + 3
    place = np.full((h, w), -1, dtype="int64")
    place[rows + 1, cols + 1] = np.arange(len(rows))
    label = np.arange(len(rows))
    links = []
    for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = place[rows + 1 + dr, cols + 1 + dc]
        hit = other >= 0
        links.append(np.stack([np.flatnonzero(hit), other[hit]]))
    a, b = np.concatenate(links, axis=1)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def component_sizes(mask: DataFrame, image: str, row: str, col: str) -> DataFrame:
    """``image, n_pixels, n_components, largest`` of the masked pixels of each image, 8-connected.

    Each image is labelled in one task; its size is bounded by the sensor's grid. Repeated pixels count once;
    an image without masked pixels has no row.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.drop_duplicates()
        label = _components(d["r"].to_numpy("int64"), d["c"].to_numpy("int64"))
        sizes = np.bincount(label)
        sizes = sizes[sizes > 0]
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "n_pixels": [len(d)], "n_components": [len(sizes)], "largest": [int(sizes.max())]})

    rows = mask.select(F.col(image).alias("image_id"), F.col(row).cast("int").alias("r"), F.col(col).cast("int").alias("c")).where("r >= 0 and c >= 0")
    return rows.groupBy("image_id").applyInPandas(run, "image_id string, n_pixels long, n_components long, largest long")


def mutual_information(df: DataFrame, keys: Sequence[str], a: str, b: str, bins: int = 32) -> DataFrame:
    """Normalised mutual information of two columns per key from a joint histogram over each column's range."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    ok = df.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*keys, x.alias("x"), y.alias("y"))
    ends = ok.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins))).otherwise(0)
    joint = ok.join(ends, list(keys)).groupBy(*keys, cell("x", "x0", "x1").alias("i"), cell("y", "y0", "y1").alias("j")).agg(F.count("*").alias("n"))
    plogp = lambda d: d.groupBy(*keys).agg(F.sum(F.col("n") * F.ln("n")).alias("s"), F.sum("n").alias("t")).select(*keys, (F.ln("t") - F.col("s") / F.col("t")).alias("h"))
    hx = plogp(joint.groupBy(*keys, "i").agg(F.sum("n").alias("n"))).withColumnRenamed("h", "hx")
    hy = plogp(joint.groupBy(*keys, "j").agg(F.sum("n").alias("n"))).withColumnRenamed("h", "hy")
    out = plogp(joint).join(hx, list(keys)).join(hy, list(keys))
    nmi = 2 * (F.col("hx") + F.col("hy") - F.col("h")) / F.greatest(F.col("hx") + F.col("hy"), F.lit(1e-12))
    return out.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), nmi)).alias("nmi"))


def correlation(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """``keys, ncc``: normalised cross-correlation of two columns over the rows where both are finite; 0 where either does not vary."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    ok = df.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return ok.groupBy(*keys).agg(F.when(spread * F.count("*") > 1e-12, F.try_divide(F.covar_pop(x, y), spread)).otherwise(F.lit(0.0)).alias("ncc"))


def edge_overlap(pixels: DataFrame, image: str, row: str, col: str, a: Column, b: Column, reach: int = 2) -> DataFrame:
    """``image, n_a, n_b, f1``: F1 of two masks where a pixel agrees if the other mask has one within ``reach`` steps along rows and columns.

    0 where either mask is empty or nothing agrees. Repeated pixels count once; images without masked pixels
    have no row. Masks meet on the pixels they reach, so cost is linear in them.
    """
    at = [image, row, col]
    masks = pixels.where(a | b).select(*at, a.cast("int").alias("a"), b.cast("int").alias("b")).groupBy(*at).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if abs(i) + abs(j) <= reach]
    far = masks.withColumn("s", F.explode(F.array(*steps))).select(image, (F.col(row) + F.col("s.i")).alias(row), (F.col(col) + F.col("s.j")).alias(col), F.col("a").alias("near_a"), F.col("b").alias("near_b"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    own = masks.select(image, F.col(row).cast("int").alias(row), F.col(col).cast("int").alias(col), F.lit(0).alias("near_a"), F.lit(0).alias("near_b"), "a", "b")
    cells = far.unionByName(own).groupBy(*at).agg(*[F.max(c).alias(c) for c in ("near_a", "near_b", "a", "b")]).where("a = 1 or b = 1")
    g = cells.groupBy(image).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("near_b")).alias("x"), F.sum(F.col("b") * F.col("near_a")).alias("y"))
    precision, recall = F.try_divide(F.col("x"), F.col("n_a")), F.try_divide(F.col("y"), F.col("n_b"))
    return g.select(image, "n_a", "n_b", F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))
