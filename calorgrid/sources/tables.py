"""Tabular sources and sinks with fixed schemas, defaults and contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


class ContractError(ValueError):
    """An input does not hold what it must."""


def with_defaults(df: DataFrame, wanted: dict[str, object], aliases: dict[str, Sequence[str]] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """``df`` with the wanted columns only: taken, else from the first alias there is, else the default.

    ``wanted`` maps names to defaults; a missing required column is an error.
    """
    have = {c.lower(): c for c in df.columns}
    out = []
    for name, default in wanted.items():
        found = next((have[a.lower()] for a in [name, *(aliases or {}).get(name, ())] if a.lower() in have), None)
        if found is None and name in required:
            raise ContractError(f"missing column {name}")
        out.append((F.col(found) if found else F.lit(default)).alias(name))
    return df.select(*out)


def read_canonical(spark: SparkSession, path: str, columns: dict[str, object], required: Sequence[str] = ()) -> DataFrame:
    """A Parquet table projected to the columns that are wanted, absent ones filled with defaults; filters reach the scan."""
    return with_defaults(spark.read.parquet(path), columns, required=required)


def read_sample(spark: SparkSession, path: str, required: Sequence[str], key: str, finite: str) -> DataFrame:
    """A sample checked by one aggregate: required columns, a unique key and finite values."""
    df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns {missing}")
    v = F.col(finite).cast("double")
    n, bad = df.agg(F.count("*"), F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).first()
    if bad:
        raise ContractError(f"{bad} of {n} values of {finite} are not finite")
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ContractError(f"{key} is not unique")
    return df


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, every column a text; empty fields are '' and not null."""
    df = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\u0001").option("emptyValue", "").csv(path)
    return df.na.fill("")


def one_row_each(df: DataFrame, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """The table if no key repeats and (if given) every wanted key is there; else an error that names some."""
    twice = [r[0] for r in df.groupBy(key).count().where("count > 1").limit(3).collect()]
    if twice:
        raise ContractError(f"repeated {key}: {twice}")
    if wanted is not None:
        lost = [r[0] for r in wanted.select(key).join(df, key, "left_anti").limit(3).collect()]
        if lost:
            raise ContractError(f"missing {key}: {lost}")
    return df


def write_canonical(df: DataFrame, path: str, partition: str = "image_id", schema: Sequence[str] | None = None) -> None:
    """Zstandard Parquet partitioned by image, columns in a fixed order; Spark's commit protocol makes it appear whole.

    Rows are laid out by partition first, so every image is written by few tasks.
    """
    df = df.select(*schema) if schema else df
    df.repartition(partition).write.mode("overwrite").option("compression", "zstd").partitionBy(partition).parquet(path)


def ordered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in this order, absent ones null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def strict_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, nulls kept and NaN or infinite numbers as null."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        cols.append((F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) if kind in ("double", "float") else c).alias(name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def geojson_features(df: DataFrame, west: str, south: str, east: str, north: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature per row: the rectangle as a closed ring and the properties."""
    p = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(p(west, south), p(east, south), p(east, north), p(west, north), p(west, south))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))
