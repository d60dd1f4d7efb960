"""Dense matrices as rows: NPY files and raw float32 buffers."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS = "image_id string, thermal_row int, thermal_col int, value double"


def _flat(name: str, m: np.ndarray, most: int = 1 << 18) -> Iterator[pd.DataFrame]:
    if m.ndim != 2 or not m.size:
        raise ValueError(f"{name}: not a non-empty 2-D matrix")
    step = max(1, most // m.shape[1])
    for top in range(0, m.shape[0], step):
        part = np.asarray(m[top : top + step], dtype="float64")
        r, c = np.indices(part.shape)
        yield pd.DataFrame({"image_id": name, "thermal_row": r.ravel() + top, "thermal_col": c.ravel(), "value": part.ravel()})


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("image_id"), "content")


def read_npy(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    """``image_id, thermal_row, thermal_col, value`` of every NPY matrix below ``path``, one file per task at least; other shapes are errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["image_id"], pdf["content"]):
                yield from _flat(name, np.load(io.BytesIO(content), allow_pickle=False))

    return _files(spark, path, glob).mapInPandas(run, ROWS)


def read_raw(spark: SparkSession, path: str, width: int, height: int, glob: str = "*.raw") -> DataFrame:
    """The same of raw little-endian float32 buffers, whose size must be ``width * height``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["image_id"], pdf["content"]):
                if len(content) != 4 * width * height:
                    raise ValueError(f"{name}: {len(content)} bytes instead of {4 * width * height}")
                yield from _flat(name, np.frombuffer(content, dtype="<f4").reshape(height, width))

    return _files(spark, path, glob).mapInPandas(run, ROWS)


def read_masks(spark: SparkSession, path: str, shape: tuple[int, int], glob: str = "*.npy") -> DataFrame:
    """Masks as :func:`read_npy`; a mask of another shape is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["image_id"], pdf["content"]):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                if m.shape != tuple(shape):
                    raise ValueError(f"{name}: shape {m.shape} instead of {tuple(shape)}")
                yield from _flat(name, m)

    return _files(spark, path, glob).mapInPandas(run, ROWS)
