"""Per-key results that stay balanced when a few keys hold most rows.

Exact quantiles by distributed selection. The first round counts the raw rows of every key in buckets of a
fixed monotone scale; every further round lays a finer histogram over the buckets that still hold a wanted
rank, between their smallest and largest value, until a bucket is one value. All counts are mergeable and
combined map-side, so a key's values are never gathered and not even its distinct values travel: what meets
in one task is a key's histogram, whose length does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from calorgrid.runtime import broadcast_if_small, scratch

#: Buckets of a round, and the number of rows from which on a bucket is resolved with a count per value.
BUCKETS, FINISH = 512, 4096
#: First-round buckets per factor e of ``1 + |value|``: about a bucket per percent, for keys with very many
#: values; and so fine that most buckets of two-decimal readings hold one value, for many keys of few values.
SCALE, FINE = 92.0, 5000.0


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def _coarse(v: Column, scale: float = SCALE) -> Column:
    """The first round's bucket: monotone in the value, at most about 710 times ``scale`` on either side of zero."""
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * scale)).cast("int")


def _values(df: DataFrame, keys: Sequence[str], value: Column, scale: float = SCALE) -> DataFrame:
    """``keys, __v, __b`` of the finite values; -0.0 and 0.0 are one value."""
    v = value.cast("double")
    return df.where(_finite(v)).select(*keys, (v + F.lit(0.0)).alias("__v")).withColumn("__b", _coarse(F.col("__v"), scale))


def _interpolated(n: Column, lo: Column, hi: Column, p: float) -> Column:
    at = F.lit(float(p)) * (n - 1)
    return lo + (hi - lo) * (at - F.floor(at))


def _ranks(n: Column, p: float) -> tuple[Column, Column]:
    at = F.lit(float(p)) * (n - 1)
    return F.floor(at).cast("long"), F.ceil(at).cast("long")


def _narrow(hits: DataFrame) -> DataFrame:
    """The interval of a rank in the bucket that holds it: its first and last row are the bucket's smallest and largest value."""
    first, last = F.col("__k") == F.col("__below"), F.col("__k") == F.col("__below") + F.col("__c") - 1
    return hits.withColumn("__lo", F.when(last & ~first, F.col("__hi")).otherwise(F.col("__lo"))).withColumn("__hi", F.when(first, F.col("__lo")).otherwise(F.col("__hi")))


def _first_round(cells: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """``keys, __n, __k, __b, __lo, __hi, __c, __below`` of every wanted rank from the first histogram."""
    by = W.partitionBy(*keys)
    h = cells.withColumn("__n", F.sum("__c").over(by)).withColumn("__below", F.sum("__c").over(by.orderBy("__b")) - F.col("__c"))
    ends = F.array_distinct(F.array(*[k for p in probs for k in _ranks(F.col("__n"), p)]))
    mine = F.filter(ends, lambda k: (k >= F.col("__below")) & (k < F.col("__below") + F.col("__c")))
    return _narrow(h.select(*keys, "__n", F.explode(mine).alias("__k"), "__b", "__lo", "__hi", "__c", "__below"))


def _next_round(values: DataFrame, todo: DataFrame, left: int, keys: list[str], buckets: int, finish: int) -> DataFrame:
    """The same of the ranks that are still open, from a finer histogram of the values in their intervals."""
    names = [*keys, "__b"]
    spans = todo.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(names)], F.col("__lo").alias("__slo"), F.col("__hi").alias("__shi"), F.col("__c").alias("__sc")).distinct()
    spans = broadcast_if_small(spans, left)
    cond = (F.col("__v") >= F.col("__slo")) & (F.col("__v") <= F.col("__shi"))
    for i, c in enumerate(names):
        cond = cond & values[c].eqNullSafe(spans[f"__s{i}"])
    # halves keep the width finite over the whole double range
    share = (F.col("__v") / 2 - F.col("__slo") / 2) / (F.col("__shi") / 2 - F.col("__slo") / 2)
    bucket = F.when(F.col("__sc") <= finish, F.col("__v")).otherwise(F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("double"))
    interval = [*[f"__s{i}" for i in range(len(names))], "__slo", "__shi"]
    hist = values.join(spans, cond).groupBy(*interval, bucket.alias("__f")).agg(F.count("*").alias("__hc"), F.min("__v").alias("__hl"), F.max("__v").alias("__hh"))
    hist = hist.withColumn("__hb", F.sum("__hc").over(W.partitionBy(*interval).orderBy("__f")) - F.col("__hc"))
    cond = (todo["__lo"] == hist["__slo"]) & (todo["__hi"] == hist["__shi"])
    for i, c in enumerate(names):
        cond = cond & todo[c].eqNullSafe(hist[f"__s{i}"])
    rank = F.col("__k") - F.col("__below")
    hits = todo.join(hist, cond & (rank >= F.col("__hb")) & (rank < F.col("__hb") + F.col("__hc")))
    below = F.col("__below") + F.col("__hb")
    return _narrow(hits.select(*keys, "__n", "__k", "__b", F.col("__hl").alias("__lo"), F.col("__hh").alias("__hi"), F.col("__hc").alias("__c"), below.alias("__below")))


def _select(values: DataFrame, cells: DataFrame, keys: list[str], probs: dict[str, float], buckets: int, finish: int) -> DataFrame:
    """Refines the histogram ``cells`` of ``values`` until every rank is one value."""
    step = scratch(_first_round(cells, keys, list(probs.values())))
    found = None
    while True:
        done = step.where("__lo = __hi").select(*keys, "__n", "__k", F.col("__lo").alias("__v"))
        found = done if found is None else found.unionByName(done)
        todo = step.where("__lo < __hi")
        left = todo.count()
        if not left:
            break
        # ranks share the interval of their bucket, whatever rank was narrowed to its ends
        step = scratch(_next_round(values, todo, left, keys, buckets, finish))
    grouped = found.groupBy(*keys, "__n").agg(F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias("__m"))  # two ranks per entry of probs
    outs = []
    for name, p in probs.items():
        lo, hi = (F.element_at("__m", k) for k in _ranks(F.col("__n"), p))
        outs.append(_interpolated(F.col("__n"), lo, hi, p).alias(name))
    return grouped.select(*keys, F.col("__n").alias("n_values"), *outs)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: dict[str, float], buckets: int = BUCKETS, finish: int = FINISH, reread: bool = False, scale: float = SCALE) -> DataFrame:
    """Exact quantiles (linear between neighbours) of the finite values per key.

    Returns ``keys..., n_values`` and one double column per entry of ``probs``. Null, NaN and infinite
    values are left out; a key without a finite value has no row; a null key is a key of its own; an
    empty input gives no row. The values are read once per round (from a scratch table, or with ``reread``
    from ``df`` itself, which then should be a plain scan) and only histograms are shuffled: the first has
    ``scale`` buckets per factor e of value, every further one divides the open intervals by ``buckets``.
    """
    keys = list(keys)
    values = _values(df, keys, value, scale)
    values = values if reread else scratch(values)
    cells = values.groupBy(*keys, "__b").agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    return _select(values, cells, keys, probs, buckets, finish)


def key_profile(df: DataFrame, key: str, value: str, probs: dict[str, float] | None = None, buckets: int = BUCKETS, finish: int = FINISH) -> DataFrame:
    """Complete per-key results without imbalance: ``key, n_rows, total, n_values`` and exact quantiles of ``value``.

    ``n_rows`` counts all rows of the key, ``total`` sums ``value`` with null and NaN as 0, ``n_values``
    counts finite values (0 and null quantiles where there are none). The null key is reported as a row
    of its own. Rows and totals are sums over the first round's histogram, which has a bucket for rows
    without a finite value; ``df`` is read once per round and should be a plain scan.
    """
    cells = scratch(key_histogram(df, key, value))
    sums = _totals(cells, key)
    parts = _select(_values(df, [key], F.col(value)), cells.where("__b is not null"), [key], probs or {"median": 0.5}, buckets, finish).withColumnRenamed(key, "__k")
    joined = sums.join(parts, sums[key].eqNullSafe(parts["__k"]), "left")
    return joined.select(key, "n_rows", "total", F.coalesce("n_values", F.lit(0).cast("long")).alias("n_values"), *(probs or {"median": 0.5}))


def key_histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """The first round's histogram: ``key, __b, __rows, __total, __c, __lo, __hi``; the null bucket holds rows without a finite value."""
    v = F.col(value).cast("double") + F.lit(0.0)
    finite = F.when(_finite(v), v)
    summed = F.when(~F.isnan(v), F.col(value))
    cells = df.groupBy(key, _coarse(finite).alias("__b")).agg(
        F.count("*").alias("__rows"), F.coalesce(F.sum(summed), F.lit(0)).alias("__total"), F.count(finite).alias("__c"), F.min(finite).alias("__lo"), F.max(finite).alias("__hi")
    )
    return cells


def _totals(cells: DataFrame, key: str) -> DataFrame:
    return cells.groupBy(key).agg(F.sum("__rows").alias("n_rows"), F.sum("__total").alias("total"))


def hot_keys(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """``key`` of the non-null keys that hold at least ``share`` of all rows or of the whole total of ``value``.

    Rows and totals are those of :func:`key_profile`, added up from the buckets of the first round. Null and
    NaN values count as 0; a total that is not positive makes no key hot.
    """
    sums = scratch(_totals(key_histogram(df, key, value), key))
    whole = sums.agg(F.sum("n_rows"), F.sum("total")).first()
    rows, total = float(whole[0] or 0), float(whole[1] or 0)
    heavy = (F.col("n_rows") >= share * rows) | ((F.col("total") >= share * total) & F.lit(total > 0))
    return sums.where(F.col(key).isNotNull() & heavy).select(key)
