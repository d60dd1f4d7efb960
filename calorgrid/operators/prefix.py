"""Running sums over a global order without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from calorgrid.runtime import broadcast_if_small, scratch


def prefix_sum(df: DataFrame, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Adds, per entry of ``sums``, the sum of its expression over all rows before (not including) the row in ``order``.

    ``order`` must be unique. Rows are range-partitioned and sorted once; the partitions' totals, one row
    each, give the offsets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = {k: v.alias(f"__v_{k}") for k, v in sums.items()}
    laid = df.select("*", *named.values()).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    laid = scratch(laid)
    before = W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = laid.groupBy("__p").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    offsets = totals.select(F.col("__p").alias("__q"), *[F.coalesce(F.sum(f"__t_{k}").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"__o_{k}") for k in sums])  # one row per partition
    small = broadcast_if_small(offsets, n)
    out = laid.withColumns({f"__b_{k}": F.coalesce(F.sum(f"__v_{k}").over(before), F.lit(0)) for k in sums}).join(small, F.col("__p") == F.col("__q"))
    return out.select(*df.columns, *[(F.col(f"__b_{k}") + F.col(f"__o_{k}")).alias(k) for k in sums])
