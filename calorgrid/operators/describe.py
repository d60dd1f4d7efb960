"""Grouped descriptions, extremes and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from calorgrid.functions.predicates import finite
from calorgrid.operators.selection import FINE, exact_quantiles

SPREAD = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def describe(df: DataFrame, keys: Sequence[str], value: Column, probs: dict[str, float] = SPREAD, single_sd: float | None = 0.0, digits: int = 4) -> DataFrame:
    """``n, mean, sd, min, max`` and exact quantiles of the finite values per key (null keys kept), rounded.

    The deviation of one value is ``single_sd``. Moments combine map-side and the quantiles come from
    distributed selection, so a key may hold any share of the rows.
    """
    keys = list(keys)
    v = F.when(finite(value), value.cast("double"))
    base = df.select(*keys, v.alias("__x"))
    sd = F.stddev_samp("__x")
    moments = base.groupBy(*keys).agg(F.count("__x").alias("n"), F.avg("__x").alias("mean"), (sd if single_sd is None else F.coalesce(sd, F.when(F.count("__x") == 1, F.lit(single_sd)))).alias("sd"), F.min("__x").alias("min"), F.max("__x").alias("max"))
    q = exact_quantiles(base, keys, F.col("__x"), probs, scale=FINE)
    q = q.toDF(*[f"__{c}" if c in keys else c for c in q.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & moments[k].eqNullSafe(q[f"__{k}"])
    stats = ["mean", "sd", "min", "max", *probs]
    return moments.join(q, cond, "left").select(*keys, "n", *[F.round(c, digits).alias(c) for c in stats])


def zero_filled(df: DataFrame, outer: DataFrame, keys: Sequence[str], dimension: str, members: Sequence, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates per key and member of a fixed dimension; members without rows have counts of 0.

    ``outer`` has the keys that must appear. Aggregates named ``n...`` are counts.
    """
    full = outer.select(*keys).distinct().withColumn(dimension, F.explode(F.array(*[F.lit(m) for m in members])))
    got = df.groupBy(*keys, dimension).agg(*[a.alias(k) for k, a in aggs.items()])
    out = full.join(got, [*keys, dimension], "left")
    return out.select(*keys, dimension, *[(F.coalesce(F.col(k), F.lit(0).cast("long")) if k.startswith("n") else F.col(k)).alias(k) for k in aggs])


def extremes(df: DataFrame, keys: Sequence[str], value: str, row: str, col: str, tolerance: float = 1e-7) -> DataFrame:
    """Per key the smallest and largest finite value, how often each occurs, q01/q99, exceedances of q99 and the first place (row-major) of each extreme."""
    keys = list(keys)
    base = df.where(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("__x"), F.col(row).alias("__r"), F.col(col).alias("__c"))
    at = F.struct("__r", "__c")
    ends = base.groupBy(*keys).agg(F.min("__x").alias("min_value"), F.max("__x").alias("max_value"), F.count("*").alias("n"), F.min_by(at, F.struct("__x", "__r", "__c")).alias("__lo"), F.min_by(at, F.struct((-F.col("__x")).alias("m"), "__r", "__c")).alias("__hi"))
    q = exact_quantiles(base, keys, F.col("__x"), {"q01": 0.01, "q99": 0.99}, scale=FINE).drop("n_values")
    rename = lambda d: d.toDF(*[f"__{c}" if c in keys else c for c in d.columns])
    q = rename(q)
    same = lambda a, b: [a[k].eqNullSafe(b[f"__{k}"]) for k in keys]
    levels = ends.join(q, same(ends, q)).drop(*[f"__{k}" for k in keys])
    lv = rename(levels)
    x = F.col("__x")
    counts = base.join(lv, same(base, lv)).groupBy(*keys).agg(
        F.count_if(F.abs(x - F.col("min_value")) <= tolerance).alias("n_min_ties"), F.count_if(F.abs(x - F.col("max_value")) <= tolerance).alias("n_max_ties"), F.count_if(x > F.col("q99")).alias("n_above_q99")
    )
    c = rename(counts)
    out = levels.join(c, same(levels, c))
    return out.select(
        *keys, "n", "min_value", "max_value", "q01", "q99", "n_min_ties", "n_max_ties", "n_above_q99", F.col("__lo.__r").alias("min_row"), F.col("__lo.__c").alias("min_col"), F.col("__hi.__r").alias("max_row"), F.col("__hi.__c").alias("max_col")
    )


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value per key; of equally frequent ones the smallest. Counted in two steps, so a key may be hot."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("__n")).alias("n"), F.col(value))).alias(value), F.max("__n").alias("n"))


def mean_of_means(df: DataFrame, keys: Sequence[str], unit: str, value: str) -> DataFrame:
    """Mean of the units' means per key (every unit weighs the same) and the number of units."""
    per = df.where(finite(F.col(value))).groupBy(*keys, unit).agg(F.avg(F.col(value).cast("double")).alias("__m"))
    return per.groupBy(*keys).agg(F.avg("__m").alias("mean"), F.count("*").alias("n_units"))


def composition(df: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """Shares of the parts per key, the total by a second, small aggregate."""
    n = df.groupBy(*keys, part).agg(F.count("*").alias("n"))
    t = n.groupBy(*keys).agg(F.sum("n").alias("total")).toDF(*[f"__{k}" for k in keys], "total")
    cond = F.lit(True)
    for k in keys:
        cond = cond & n[k].eqNullSafe(t[f"__{k}"])
    return n.join(t, cond).select(*keys, part, "n", (F.col("n") / F.col("total")).alias("share"))


def findings(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, field, n_missing, n_distinct, values`` for each metadata field: what is missing and what differs."""
    cols = F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias("v")) for f in fields])
    long = df.select(key, F.explode(cols).alias("f")).select(key, "f.field", "f.v").groupBy(key, "field", "v").agg(F.count("*").alias("n"))
    return long.groupBy(key, "field").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"), F.count("v").alias("n_distinct"))
