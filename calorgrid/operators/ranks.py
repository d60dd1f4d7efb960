"""Rank tests between groups from mergeable counts per distinct value.

Distinct values with their count per group are range-partitioned; a first pass gives every partition the
counts below it, a second adds up rank sums and pairwise U statistics. No group is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from calorgrid.operators.selection import FINE, exact_quantiles
from calorgrid.runtime import scratch



def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@pandas_udf(DoubleType())
def chi2_tail(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([upper_gamma(f / 2, s / 2) if s == s and f >= 1 else math.nan for s, f in zip(statistic, freedom)], dtype=float)


@pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, math.erfc(v / math.sqrt(2))) if v == v else math.nan for v in z], dtype=float)


class _Sweep:
    """Sums over the sorted values of one scope in one partition, given the counts below the partition."""

    def __init__(self, names: list[str], below: np.ndarray):
        self.names, self.low = names, below.astype(float)
        self.index = {g: i for i, g in enumerate(names)}
        k = len(names)
        self.rank, self.ties, self.u = np.zeros(k), 0.0, np.zeros((k, k))
        self.cubes, self.mixed = np.zeros(k), np.zeros((k, k))

    def add(self, v: np.ndarray, g: list[str], n: np.ndarray) -> None:
        """Whole runs of equal values."""
        run = np.cumsum(np.concatenate([[0], (v[1:] != v[:-1]).astype(int)]))
        c = np.zeros((run[-1] + 1, len(self.names)))
        np.add.at(c, (run, [self.index[x] for x in g]), n)
        under = self.low + np.cumsum(c, axis=0) - c
        self.low = self.low + c.sum(axis=0)
        t = c.sum(axis=1)
        self.rank += c.T @ (under.sum(axis=1) + (t + 1) / 2)
        self.ties += float((t**3 - t).sum())
        self.u += c.T @ (under + c / 2)
        # (x + y)^3 - (x + y), summed for every pair of groups
        square = (c * c).T @ c
        self.cubes += (c**3 - c).sum(axis=0)
        self.mixed += 3 * (square + square.T)

    def rows(self, scope: str) -> list[tuple]:
        k, names = len(self.names), self.names
        out = [(scope, "g", names[i], "", self.rank[i], self.ties) for i in range(k)]
        pair = self.cubes[:, None] + self.cubes[None, :] + self.mixed
        return out + [(scope, "p", names[a], names[b], self.u[a, b], pair[a, b]) for a in range(k) for b in range(a + 1, k)]


_SUMS = ["s", "kind", "a", "b", "x", "t"]


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows ``p, s, v, g, n`` sorted by partition, scope and value; rows without a value come first and hold the counts below."""
    at = sweep = held = None
    head: list[pd.DataFrame] = []
    out: list[tuple] = []

    def begin() -> _Sweep:
        h = pd.concat(head).sort_values("g")
        head.clear()
        return _Sweep(h["g"].tolist(), h["n"].to_numpy())

    def close() -> None:
        nonlocal sweep, held
        if at is None:
            return
        sweep = sweep or begin()
        if held is not None:
            sweep.add(held["v"].to_numpy(), held["g"].tolist(), held["n"].to_numpy())
        out.extend(sweep.rows(at[1]))
        sweep = held = None

    for pdf in batches:
        for key, part in pdf.groupby(["p", "s"], sort=False):
            if key != at:
                close()
                at = key
            missing = part["v"].isna()
            if missing.any():
                head.append(part[missing])
                part = part[~missing]
            if part.empty:
                continue
            sweep = sweep or begin()
            part = part if held is None else pd.concat([held, part])
            last = part["v"].to_numpy() == part["v"].iloc[-1]  # its run may go on in the next batch
            held, part = part[last], part[~last]
            if len(part):
                sweep.add(part["v"].to_numpy(), part["g"].tolist(), part["n"].to_numpy())
        yield pd.DataFrame(out, columns=_SUMS)
        out = []
    close()
    yield pd.DataFrame(out, columns=_SUMS)


def rank_statistics(df: DataFrame, group: str, value: str, scope: Column | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(groups, pairs)``: per group ``s, g, n, rank_sum`` over all groups of its scope with ``n_all, ties``; per pair ``a < b`` of a scope ``s, n_a, n_b, u`` (of a) and ``ties``.

    Scopes (text, one if none is given) are ranked apart. Null, NaN and infinite values and null groups are
    left out. ``weight`` is how often a row's value counts. Groups are meant to be few: all their pairs come out, and a task holds a number per pair.
    """
    v = F.col(value).cast("double")
    s = F.lit("") if scope is None else scope.cast("string")
    rows = df.where(F.col(group).isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    counts = scratch(rows.groupBy(s.alias("s"), F.col(group).cast("string").alias("g"), (v + F.lit(0.0)).alias("v")).agg((F.sum(weight) if weight else F.count("*")).alias("n")))
    sizes = scratch(counts.groupBy("s", "g").agg(F.sum("n").alias("n")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = scratch(counts.repartitionByRange(parts, "s", "v").withColumn("p", F.spark_partition_id()))  # a value of a scope lies in one partition
    # every group's count below every partition of its scope: partitions x groups rows
    every = laid.select("p", "s").distinct().join(sizes.select("s", "g"), "s")
    totals = laid.groupBy("p", "s", "g").agg(F.sum("n").alias("n"))
    below = F.coalesce(F.sum("n").over(W.partitionBy("s", "g").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = every.join(totals, ["p", "s", "g"], "left").select("p", "s", F.lit(None).cast("double").alias("v"), "g", below.alias("n"))
    swept = laid.select("p", "s", "v", "g", "n").unionByName(heads).repartition(parts, "p").sortWithinPartitions("p", "s", F.col("v").asc_nulls_first())
    sums = scratch(swept.mapInPandas(_sweep, "s string, kind string, a string, b string, x double, t double").groupBy("s", "kind", "a", "b").agg(F.sum("x").alias("x"), F.sum("t").alias("t")))
    whole = sizes.groupBy("s").agg(F.sum("n").cast("double").alias("n_all"))
    groups = sums.where("kind = 'g'").join(sizes.withColumnRenamed("g", "a"), ["s", "a"]).join(whole, "s").select("s", F.col("a").alias("g"), "n", F.col("x").alias("rank_sum"), "n_all", F.col("t").alias("ties"))
    na, nb = sizes.toDF("s", "a", "n_a"), sizes.toDF("s", "b", "n_b")
    pairs = sums.where("kind = 'p'").join(na, ["s", "a"]).join(nb, ["s", "b"]).select("s", "a", "b", "n_a", "n_b", F.col("x").alias("u"), F.col("t").alias("ties"))
    return groups, pairs


def kruskal_wallis(groups: DataFrame) -> DataFrame:
    """``s, n_groups, statistic, freedom, p_value`` per scope of :func:`rank_statistics`; null statistic for fewer than two groups or equal values only."""
    n = F.max("n_all")
    h = 12 / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")) - 3 * (n + 1)
    fix = 1 - F.try_divide(F.max("ties"), n * n * n - n)
    s = groups.groupBy("s").agg(F.count("*").alias("n_groups"), F.when((F.count("*") >= 2) & (fix > 0), F.try_divide(h, fix)).alias("statistic"), (F.count("*") - 1).cast("int").alias("freedom"))
    return s.withColumn("p_value", chi2_tail("statistic", "freedom"))


def mann_whitney(pairs: DataFrame) -> DataFrame:
    """Pairs with ``p_value`` (two-sided, normal with tie and continuity correction), ``effect`` (rank-biserial) and ``adjusted`` (Benjamini-Hochberg within the scope)."""
    n = (F.col("n_a") + F.col("n_b")).cast("double")
    prod = F.col("n_a") * F.col("n_b")
    var = prod / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    z = (F.abs(F.col("u") - prod / 2.0) - 0.5) / F.sqrt(F.when(var > 0, var))
    p = pairs.withColumn("p_value", normal_two_sided(F.greatest(z, F.lit(0.0)))).withColumn("effect", 2.0 * F.col("u") / prod - 1)
    return with_adjusted(p, ["s"], ["a", "b"])


def with_adjusted(tests: DataFrame, scope: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Adds ``adjusted``: Benjamini-Hochberg over the finite ``p_value`` of each scope, whose tests are few."""
    ok = F.col("p_value").isNotNull() & ~F.isnan("p_value")
    every = W.partitionBy(*scope)
    rank = F.row_number().over(every.orderBy(F.col("__p").asc_nulls_last(), *names))
    p = tests.withColumn("__p", F.when(ok, F.col("p_value"))).withColumn("__r", rank).withColumn("__q", F.col("__p") * F.count("__p").over(every) / F.col("__r"))
    down = every.orderBy(F.desc("__r")).rowsBetween(W.unboundedPreceding, 0)
    return p.withColumn("adjusted", F.when(ok, F.least(F.lit(1.0), F.min("__q").over(down)))).drop("__p", "__r", "__q")


#: Least sampled pixels and images of a group that is tested (fixed values).
LEAST_PIXELS, LEAST_IMAGES = 100, 2


def group_tests(sample: DataFrame, *, scope: str, group: str, unit: str, value: str, least: int = LEAST_PIXELS, least_units: int = LEAST_IMAGES) -> tuple[DataFrame, DataFrame]:
    """Tests between the groups of every scope of a sample: one global row per scope and one row per pair ``group_a < group_b``.

    Global: ``scope, n_groups, statistic, freedom, p_value, status, reason``, Kruskal-Wallis over the groups
    with at least ``least`` values from ``least_units`` units; fewer than two such groups skip it. Pairs:
    ``scope, group_a, group_b, n_a, n_b, images_a, images_b, u, p_value, adjusted, effect, mean_difference,
    median_difference, status, reason``; pairs with a group that is too small are skipped with the reason.
    """
    rows = scratch(sample.where(F.col(group).isNotNull()).select(F.col(scope).cast("string").alias("s"), F.col(group).cast("string").alias("g"), F.col(unit).alias("unit"), F.col(value).cast("double").alias("v")))
    per_unit = rows.groupBy("s", "g", "unit").agg(F.count("*").alias("n"), F.sum("v").alias("t"))
    info = scratch(per_unit.groupBy("s", "g").agg(F.sum("n").alias("n"), F.count("unit").alias("images"), (F.sum("t") / F.sum("n")).alias("mean")))
    valid = info.where((F.col("n") >= least) & (F.col("images") >= least_units)).select("s", "g")
    tested = rows.join(valid, ["s", "g"], "left_semi")
    groups, pairs = rank_statistics(tested, "g", "v", F.col("s"))
    scopes = info.select("s").distinct()
    kw = kruskal_wallis(groups).where("n_groups >= 2")
    status = F.when(F.col("n_groups").isNotNull(), "exploratory_only_spatial_dependence_remains").otherwise("skipped")
    why = F.when(F.col("n_groups").isNull(), "Fewer than two groups meet both minimum sampled-pixel and minimum-image rules.").otherwise("")
    overall = scopes.join(kw, "s", "left").select(F.col("s").alias("scope"), "n_groups", "statistic", "freedom", "p_value", status.alias("status"), why.alias("reason"))
    q = exact_quantiles(rows, ["s", "g"], F.col("v"), {"median": 0.5}, reread=True, scale=FINE).drop("n_values")
    info = scratch(info.join(q, ["s", "g"], "left"))
    a, b = (info.toDF("s", *[f"{c}_{side}" for c in ("group", "n", "images", "mean", "median")]) for side in "ab")
    every = a.join(b, "s").where("group_a < group_b")  # groups of a scope are few
    few = F.when(F.least("n_a", "n_b") < least, f"At least one group has fewer than {least} sampled pixels.").when(F.least("images_a", "images_b") < least_units, f"At least one group occurs in fewer than {least_units} images.").otherwise("")
    tests = mann_whitney(pairs).select("s", F.col("a").alias("group_a"), F.col("b").alias("group_b"), "u", "p_value", "adjusted", "effect")
    out = every.withColumn("reason", few).join(tests, ["s", "group_a", "group_b"], "left")
    done = F.col("reason") == ""
    differences = [F.when(done, F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"{c}_difference") for c in ("mean", "median")]
    status = F.when(done, "exploratory_only_spatial_dependence_remains").otherwise("skipped")
    return overall, out.select(F.col("s").alias("scope"), "group_a", "group_b", "n_a", "n_b", "images_a", "images_b", "u", "p_value", "adjusted", "effect", *differences, status.alias("status"), "reason")
