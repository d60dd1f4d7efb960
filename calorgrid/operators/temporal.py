"""Capture-level series: gates, ranges, sampling coverage and pixelwise change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOUR_US = 3_600_000_000


def _us(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def duplicate_times(captures: DataFrame, stratum: Sequence[str], at: str) -> DataFrame:
    """The captures with ``duplicate_time``: every copy of a time that a stratum has more than once. Counted map-side and joined back."""
    n = captures.groupBy(*stratum, at).agg(F.count("*").alias("__n")).where("__n > 1")
    right = n.toDF(*[f"__{c}" for c in [*stratum, at]], "__n")
    cond = F.lit(True)
    for c in [*stratum, at]:
        cond = cond & captures[c].eqNullSafe(right[f"__{c}"])
    return captures.join(right, cond, "left").withColumn("duplicate_time", F.col("__n").isNotNull()).select(*captures.columns, "duplicate_time")


def peak_to_trough(captures: DataFrame, keys: Sequence[str], image: str, at: str, statistics: dict[str, str | tuple[str, str]]) -> DataFrame:
    """Per key and statistic the highest and lowest capture, their distance in value and in hours.

    ``statistics`` maps names to a column, or to one whose maximum and one whose minimum counts. Fewer than
    two distinct images, or no finite value, give an unavailable row with the reason. Of equal values the
    earliest capture counts, then the smaller image id.
    """
    sides = {name: c if isinstance(c, tuple) else (c, c) for name, c in statistics.items()}
    stats = F.array(*[F.struct(F.lit(name).alias("statistic"), F.col(c).cast("double").alias("v"), F.col(d).cast("double").alias("w")) for name, (c, d) in sides.items()])
    long = captures.select(*keys, F.col(image).alias("__i"), _us(at).alias("__t"), F.explode(stats).alias("s")).select(*keys, "__i", "__t", "s.*")
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    v, w = F.col("v"), F.col("w")
    high = F.min_by(F.struct("v", "__t", "__i"), F.when(ok(v), F.struct((-v).alias("a"), "__t", "__i")))
    low = F.min_by(F.struct(w.alias("v"), "__t", "__i"), F.when(ok(w), F.struct("w", "__t", "__i")))
    g = long.groupBy(*keys, "statistic").agg(F.count_distinct("__i").alias("n_captures"), high.alias("h"), low.alias("l"))
    reason = F.when(F.col("n_captures") < 2, "fewer_than_two_compatible_captures").when(F.col("h").isNull() | F.col("l").isNull(), "value_missing").otherwise("")
    g = g.withColumn("unavailable_reason", reason)
    got = lambda c: F.when(F.col("unavailable_reason") == "", c)
    return g.select(
        *keys, "statistic", "n_captures", "unavailable_reason", got(F.col("h.v")).alias("max_value"), got(F.col("h.__i")).alias("max_image"), got(F.col("l.v")).alias("min_value"), got(F.col("l.__i")).alias("min_image"),
        got(F.col("h.v") - F.col("l.v")).alias("range"), got(F.abs(F.col("h.__t") - F.col("l.__t")) / HOUR_US).alias("hours_between"),
    )


def sampling_coverage(captures: DataFrame, keys: Sequence[str], image: str, at: str, local_hour: Column, confirmed: bool) -> DataFrame:
    """Per key how well its captures cover a day: count, span, largest gap, day and night, gate failures and status.

    A full day needs confirmation, six captures, day (06-17) and night, a span of 23 hours and no gap above four.
    """
    t = _us(at)
    gap = t - F.lag(t).over(W.partitionBy(*keys).orderBy(t, image))
    g = captures.withColumn("__g", gap).withColumn("__h", local_hour).groupBy(*keys).agg(
        F.count("*").alias("n_captures"), ((F.max(t) - F.min(t)) / HOUR_US).alias("span_hours"), (F.max("__g") / HOUR_US).alias("largest_gap_hours"),
        F.bool_or((F.col("__h") >= 6) & (F.col("__h") < 18)).alias("day"), F.bool_or((F.col("__h") < 6) | (F.col("__h") >= 18)).alias("night"),
    )
    fails = [
        (F.lit(not confirmed), "full_day_sampling_not_confirmed"), (F.col("n_captures") < 6, "fewer_than_six_eligible_captures"), (~F.col("day"), "daytime_not_represented"), (~F.col("night"), "nighttime_not_represented"),
        (F.col("span_hours") < 23, "observation_span_less_than_23_hours"), (F.coalesce(F.col("largest_gap_hours") > 4, F.lit(True)), "maximum_sampling_gap_exceeds_four_hours"),
    ]
    g = g.withColumn("gate_failures", F.concat_ws(";", F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in fails]))))
    status = (
        F.when(F.col("n_captures") == 1, "single_capture")
        .when(F.col("gate_failures") == "", "full_day_sampling_design_confirmed")
        .when(F.col("day") & F.col("night"), "day_and_night_observed_but_daily_extrema_not_established")
        .otherwise("partial_observation_window")
    )
    return g.withColumn("status", status)


def series_groups(captures: DataFrame, keys: Sequence[str], image: str) -> DataFrame:
    """Keys with at least two distinct images."""
    return captures.groupBy(*keys).agg(F.count_distinct(image).alias("n_images")).where("n_images >= 2")


def pixelwise_range(pixels: DataFrame, image: str, row: str, col: str, value: str, n_images: int) -> DataFrame:
    """Maximum, minimum, range and the images that hold them for each pixel that all ``n_images`` captures have; ties go to the smaller image id."""
    v = F.col(value).cast("double")
    ok = pixels.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(image, row, col, v.alias("__v"))
    g = ok.groupBy(row, col).agg(F.count_distinct(image).alias("__n"), F.max("__v").alias("max_value"), F.min("__v").alias("min_value"), F.min_by(image, F.struct((-F.col("__v")).alias("a"), image)).alias("max_image"), F.min_by(image, F.struct("__v", image)).alias("min_image"))
    return g.where(F.col("__n") == n_images).withColumn("range", F.col("max_value") - F.col("min_value")).drop("__n")


def exclusions(submitted: DataFrame, captures: DataFrame, image: str, reasons: Sequence[str]) -> DataFrame:
    """One row per submitted image with its distinct reasons in order; ``not_found`` where there is no such capture."""
    got = captures.select(F.col(image).alias("__i"), F.array_compact(F.array(*[F.nullif(F.col(r), F.lit("")) for r in reasons])).alias("__r"))
    got = got.groupBy("__i").agg(F.array_distinct(F.flatten(F.sort_array(F.collect_list("__r")))).alias("__r"))
    out = submitted.join(got, submitted[image] == got["__i"], "left")
    return out.select(image, F.when(F.col("__i").isNull(), "not_found").otherwise(F.array_join("__r", ";")).alias("reasons"))
