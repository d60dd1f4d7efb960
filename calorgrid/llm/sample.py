"""A sample that is the same in every run and only grows: frozen batch bottom-k.

Within each arrival batch of a stratum exactly ``ceil(rate * size)`` records with the smallest salted
hashes are kept. A record belongs to the batch that first delivered it, batches do not change and the rate
of a stratum is frozen by the first manifest row that can be met, so the union over batches is append-only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from calorgrid.runtime import broadcast_if_small, scratch

#: Records of one batch of a stratum that one task ranks.
CELL = 100_000


def salted(seed: Column, name: Column) -> Column:
    """A hash in hexadecimal that any engine can recompute: MD5 of ``seed|name``; a null seed is empty."""
    return F.md5(F.concat_ws("|", F.coalesce(seed.cast("string"), F.lit("")), name))


def freeze_rates(manifest: DataFrame, *, on: Sequence[str], seed: str, eligible: str, sampled: str, as_of: str, row_id: str, known: DataFrame | None = None) -> DataFrame:
    """``on, seed, rate``: the rate of each stratum and seed, frozen by its earliest row with counts that can be met.

    A row can be met if ``0 < sampled <= eligible``; rows with missing counts or more sampled than eligible
    freeze nothing, and a stratum without a row that can be met has no rate and so no sample yet. Rows are
    taken by ``as_of``, then ``row_id``. Later rows never change a rate; ``known``, the table of rates frozen
    before (same columns), also holds against rows that arrive late with an earlier ``as_of``.
    """
    e, s = F.col(eligible), F.col(sampled)
    rates = manifest.where((s > 0) & (s <= e) & F.col(as_of).isNotNull()).groupBy(*on, seed).agg(F.min_by(s / e, F.struct(as_of, row_id)).alias("rate"))
    if known is None:
        return rates
    held = known.select(*on, seed, "rate")
    other = held.toDF(*[f"__{c}" for c in held.columns])
    cond = F.lit(True)
    for c in [*on, seed]:
        cond = cond & rates[c].eqNullSafe(other[f"__{c}"])
    return held.unionByName(rates.join(other, cond, "left_anti"))


def usable(strata: DataFrame, rate: str) -> DataFrame:
    """Strata that select something, rates above 1 as 1; the filter comes first: least() passes over a null."""
    r = F.col(rate).cast("double")
    return strata.where((r > 0) & ~F.isnan(r)).withColumn(rate, F.least(r, F.lit(1.0)))


def quota(rate: Column, size: Column) -> Column:
    """``ceil(rate * size)``; products such as 0.2 * 35 must not be lifted above their integer by the last bit."""
    return F.ceil(rate * size - 1e-9)


def ranked_bottom_k(joined: DataFrame, part: Sequence[str], *, name: str, rate: str, seed: str) -> DataFrame:
    """The smallest hashes of each group of ``part``, every group ranked by one task: for groups with a bound, such as a capture's grid."""
    by = W.partitionBy(*part)
    rows = joined.withColumn("__h", salted(F.col(seed), F.col(name)))
    rows = rows.withColumn("__k", quota(F.col(rate), F.count("*").over(by))).withColumn("__r", F.row_number().over(by.orderBy("__h", name)))
    return rows.where("__r <= __k").drop("__h", "__k", "__r")


def frozen_bottom_k(records: DataFrame, strata: DataFrame, *, on: Sequence[str], name: str, batch: str, rate: str, seed: str, cell: int = CELL) -> DataFrame:
    """The selected rows of ``records`` with ``seed, rate`` of their stratum.

    ``records`` hold one row per record and stratum (``on``, ``name``, ``batch`` of first arrival); ``strata``
    hold ``on``, ``seed`` and ``rate``, several seeds per stratum giving samples of their own. Rates above 1
    select all, a null, negative or NaN rate selects none; a null seed is a seed of its own; strata or records
    with null keys do not meet. However large a batch of a stratum is, no task ranks it: its hashes are
    counted in cells of about ``cell`` records, cells below the quota are taken whole and only the cell in
    which the quota ends is ranked.
    """
    part = [*on, seed, batch]
    strata = usable(strata, rate).select(*on, seed, rate)
    rows = scratch(records.join(strata, list(on)).withColumn("__h", salted(F.col(seed), F.col(name))))

    def beside(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
        side = broadcast_if_small(right.toDF(*[f"__j_{c}" if c in keys else c for c in right.columns]), right.count())
        cond = F.lit(True)
        for c in keys:
            cond = cond & left[c].eqNullSafe(side[f"__j_{c}"])
        return left.join(side, cond, how).drop(*[f"__j_{c}" for c in keys])

    sizes = rows.groupBy(*part).agg(F.count("*").alias("__n"), F.first(rate).alias("__q"))
    sizes = scratch(sizes.select(*part, quota(F.col("__q"), F.col("__n")).alias("__k"), F.ceil(F.col("__n") / cell).alias("__cells")))
    at = F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") / float(1 << 32) * F.col("__cells"))
    rows = beside(rows, sizes, part).withColumn("__cell", at)
    counts = rows.where("__cells > 1").groupBy(*part, "__cell").agg(F.count("*").alias("__c"))
    upto = counts.withColumn("__below", F.sum("__c").over(W.partitionBy(*part).orderBy("__cell")) - F.col("__c"))  # cells of a group, not records
    rows = beside(rows, scratch(upto.select(*part, "__cell", "__below", "__c")), [*part, "__cell"], "left").withColumn("__below", F.coalesce("__below", F.lit(0)))
    whole = F.coalesce(F.col("__below") + F.col("__c") <= F.col("__k"), F.lit(False))
    rank = F.row_number().over(W.partitionBy(*part, "__cell").orderBy("__h", name))
    edge = rows.where(~whole & (F.col("__below") < F.col("__k"))).withColumn("__r", rank).where(F.col("__r") <= F.col("__k") - F.col("__below")).drop("__r")
    return rows.where(whole).unionByName(edge).drop("__h", "__k", "__cells", "__cell", "__below", "__c")
