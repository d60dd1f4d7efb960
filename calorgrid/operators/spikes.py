"""Implausible readings, judged against their own source.

Per source the level and spread are exact quantiles (see :mod:`calorgrid.operators.selection`). Residuals
from the source's seasonal level beyond an initial threshold are peaks; to the peaks of each side of each
source a generalised Pareto tail is fitted by probability-weighted moments, and the cutoff that a normal
reading exceeds with a fixed risk makes the candidates. An exact rule may judge the candidates further: the
cutoff never lies beyond what the rule would pass, so it loses nothing. Stuck runs are found in bands of the
source's order and stitched across band edges, so no task has to sort a whole hot source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from calorgrid.operators.selection import exact_quantiles
from calorgrid.runtime import broadcast_if_small, scratch

#: Bins of the excess per spread, from whose counts and sums the tails are fitted.
BINS = 64


@dataclass(frozen=True)
class SpikeRule:
    """``peak`` spreads start the tail, ``far`` spreads is the exact rule for a spike; the spread is at least ``floor``."""

    floor: float
    peak: float = 1.5
    far: float = 5.0
    risk: float = 1e-4
    least: int = 10


def clean(c: Column) -> Column:
    """The reading as a double, NaN as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def distinct_readings(df: DataFrame, source: str, order: Sequence[str], values: dict[str, Column], row_id: str, season: Column | None = None) -> DataFrame:
    """One row per source and position (re-deliveries once); a row without position stands for itself.

    Columns: ``source``, ``o0..``, ``lone``, the values and ``season``. Copies are combined map-side.
    """
    lone = F.lit(False)
    for c in order:
        lone = lone | F.col(c).isNull()
    keys = [F.col(source).alias("source"), *[F.col(c).cast("long").alias(f"o{k}") for k, c in enumerate(order)], F.when(lone, F.col(row_id)).alias("lone")]
    season = F.lit(0) if season is None else F.coalesce(season.cast("int"), F.lit(-1))  # no season is a season
    return df.groupBy(*keys).agg(*[F.min(clean(v)).alias(k) for k, v in values.items()], F.min(season).alias("season"))


def _by_reading(rules: dict[str, SpikeRule], field: str) -> Column:
    """The rule's field of a row's ``reading``."""
    out = F.lit(None)
    for name, rule in rules.items():
        out = F.when(F.col("reading") == name, F.lit(float(getattr(rule, field)))).otherwise(out)
    return out.cast("double")


def long_form(readings: DataFrame, rules: dict[str, SpikeRule]) -> DataFrame:
    """One row ``.., reading, v`` per reading that is there; all columns but the values stay."""
    others = [c for c in readings.columns if c not in rules]
    one = lambda name: F.struct(F.lit(name).alias("reading"), F.col(name).cast("double").alias("v"))
    if len(rules) == 1:
        name = next(iter(rules))
        rows = readings.select(*others, F.lit(name).alias("reading"), F.col(name).cast("double").alias("v"))
    else:
        rows = readings.select(*others, F.explode(F.array(*map(one, rules))).alias("__x")).select(*others, "__x.*")
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v"))


def _joined(rows: DataFrame, side: DataFrame, n: int, keys: Sequence[str], how: str = "inner") -> DataFrame:
    small = broadcast_if_small(side.toDF(*[f"__{c}" if c in keys else c for c in side.columns]), n)
    cond = F.lit(True)
    for k in keys:
        cond = cond & rows[k].eqNullSafe(small[f"__{k}"])
    return rows.join(small, cond, how).drop(*[f"__{k}" for k in keys])


def residuals(readings: DataFrame, rules: dict[str, SpikeRule]) -> DataFrame:
    """The :func:`long_form` with ``centre, spread, n_source`` of the source, ``level``, the centre of its season, and ``scale``, the spread of the residuals.

    The centre is the median, the spread the distance between the quartiles. A season's level is the mean of
    its readings, those beyond ``peak`` spreads moved there; the scale is the quartile distance of a normal
    law with the deviation of the moved readings from their levels, at most the spread. A source without
    seasons has one level.
    """
    rows = long_form(readings, rules)
    keys = ["source", "reading"] if len(rules) > 1 else ["source"]
    q = exact_quantiles(rows, keys, F.col("v"), {"q25": 0.25, "centre": 0.5, "q75": 0.75}, reread=True)
    q = q if "reading" in keys else q.withColumn("reading", F.lit(next(iter(rules))))
    levels = scratch(q.select("source", "reading", "centre", F.greatest(F.col("q75") - F.col("q25"), _by_reading(rules, "floor")).alias("spread"), F.col("n_values").alias("n_source")))
    judged = _joined(rows, levels, levels.count(), ["source", "reading"])
    reach = _by_reading(rules, "peak") * F.col("spread")
    moved = F.greatest(-reach, F.least(reach, F.col("v") - F.col("centre")))
    keys = ["source", "reading"]
    seasons = judged.groupBy(*keys, "season", "centre", "spread", "n_source").agg(F.avg(moved).alias("m"), F.count("*").alias("n"), F.var_pop(moved).alias("var"))
    deviation = 1.349 * F.sqrt(F.sum(F.col("n") * F.col("var")) / F.sum("n"))
    scale = F.least(F.col("spread"), F.greatest(deviation, _by_reading(rules, "floor")))
    level = F.map_from_entries(F.collect_list(F.struct("season", F.col("centre") + F.col("m"))))  # the seasons of a source
    profile = scratch(seasons.groupBy(*keys, "centre", "spread", "n_source").agg(scale.alias("scale"), level.alias("levels")))
    return _joined(rows, profile, profile.count(), keys).withColumn("level", F.col("levels")[F.col("season")]).drop("levels")


def fitted_tails(peaks: DataFrame, rules: dict[str, SpikeRule]) -> DataFrame:
    """``source, reading, upper, beyond``: by how much a normal reading exceeds the tail's start with half the risk.

    The generalised Pareto law of each side is fitted by probability-weighted moments over the excesses
    within ``far`` spreads. The moments come from counts and sums in :data:`BINS` bins a source and side, so
    no tail is gathered. Null where fewer than ``least`` peaks or equal ones only give no law.
    """
    excess = F.abs("residual") - F.col("start")
    fit = peaks.where((excess > 0) & (F.abs("residual") <= _by_reading(rules, "far") * F.col("spread"))).withColumn("excess", excess).withColumn("upper", F.col("residual") > 0)
    width = _by_reading(rules, "far") * F.col("spread") - F.col("start")
    cell = F.least(F.floor(F.col("excess") / width * BINS), F.lit(BINS - 1))
    side = ["source", "reading", "upper"]
    bins = fit.groupBy(*side, cell.alias("cell")).agg(F.count("*").alias("c"), F.sum("excess").alias("s"), F.max("n_source").alias("n_source"))
    bins = bins.withColumn("before", F.sum("c").over(W.partitionBy(*side).orderBy("cell")) - F.col("c")).withColumn("k", F.sum("c").over(W.partitionBy(*side)))
    above = F.col("k") - F.col("before") - (F.col("c") + 1) / 2  # mean number of peaks above one of the bin
    m = bins.groupBy(*side).agg(F.max("k").alias("k"), F.max("n_source").alias("n_source"), (F.sum("s") / F.max("k")).alias("a"), (F.sum(F.col("s") * above) / F.max("k") / F.greatest(F.lit(1), F.max("k") - 1)).alias("b"))
    free = F.col("a") - 2 * F.col("b")
    xi = 2 - F.try_divide(F.col("a"), free)
    xi = F.when(F.abs(xi) < 1e-6, F.lit(1e-6)).otherwise(xi)
    odds = F.col("n_source") * _by_reading(rules, "risk") / 2 / F.col("k")
    law = (F.col("k") >= _by_reading(rules, "least")) & (free > 1e-12 * F.col("a")) & (odds < 1)
    beyond = F.when(law, F.try_divide(2 * F.col("a") * F.col("b"), free) / xi * (F.pow(odds, -xi) - 1))
    return m.select(*side, beyond.alias("beyond"))


def candidates(readings: DataFrame, rules: dict[str, SpikeRule]) -> DataFrame:
    """The readings beyond the cutoff of their source's tail, one row per reading: ``.., reading, v, centre, spread, level, residual, cutoff, bound``.

    ``cutoff`` is the tail's start plus its excess at the fixed risk (``far`` spreads where there is no
    law); it is lowered to ``bound``, ``far`` spreads less the distance between seasonal level and centre:
    whatever lies more than ``far`` spreads from the centre lies beyond the bound, so none of it is lost.
    Infinite readings are candidates. Null sources are a source; null and NaN readings are none.
    """
    rows = residuals(readings, rules).withColumn("residual", F.col("v") - F.col("level")).withColumn("start", _by_reading(rules, "peak") * F.col("scale"))
    far = _by_reading(rules, "far") * F.col("spread")
    # a hair less than the bound, for the rounding of the differences
    rows = rows.withColumn("bound", (far - F.abs(F.col("level") - F.col("centre"))) * (1 - 1e-9) - 1e-9)
    peaks = scratch(rows.where(F.abs("residual") > F.least("start", "bound")))
    side = lambda up: F.max(F.when(F.col("upper") == up, F.col("beyond")))
    tails = scratch(fitted_tails(peaks, rules).groupBy("source", "reading").agg(side(True).alias("above"), side(False).alias("below")))
    out = _joined(peaks, tails, tails.count(), ["source", "reading"], "left")
    beyond = F.when(F.col("residual") > 0, F.col("above")).otherwise(F.col("below"))
    cut = F.coalesce(F.col("start") + beyond, _by_reading(rules, "far") * F.col("spread"))
    return out.withColumn("cutoff", cut).where(F.abs("residual") > F.least("cutoff", "bound")).drop("above", "below", "start", "scale")


def stuck(readings: DataFrame, value: str, order: int, band: int, least: int) -> DataFrame:
    """Readings inside a run of at least ``least`` successive equal values of a source (by its order columns).

    A missing value ends a run; rows without position take no part. Runs are formed inside bands of
    ``band`` units of the first order column; runs that touch a band's edge are joined across bands.
    """
    cols = [f"o{k}" for k in range(order)]
    r = readings.where("lone is null").select("source", *cols, F.col(value).alias("v"), F.floor(F.col("o0") / band).alias("band"))
    by_band = W.partitionBy("source", "band")
    inorder = by_band.orderBy(*cols)
    prev = F.lag("v").over(inorder)
    r = r.withColumn("__new", F.when(F.col("v").isNull() | prev.isNull() | (F.col("v") != prev), 1).otherwise(0))
    r = r.withColumn("run", F.sum("__new").over(inorder.rowsBetween(W.unboundedPreceding, 0)))
    ends = by_band.orderBy(*cols).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    r = r.withColumn("last_run", F.last("run").over(ends)).withColumn("n", F.count("*").over(W.partitionBy("source", "band", "run")))
    edge = (F.col("run") == 1) | (F.col("run") == F.col("last_run"))
    kept = scratch(r.where(edge | ((F.col("n") >= least) & F.col("v").isNotNull())).select("source", *cols, "v", "band", "run", "n", edge.alias("edge")))
    runs = kept.where("edge").groupBy("source", "band", "run").agg(F.first("n").alias("n"), F.first("v").alias("v"))
    chain = W.partitionBy("source").orderBy("band", "run")
    before = lambda c: F.lag(c).over(chain)
    breaks = F.col("v").isNull() | before("v").isNull() | (F.col("v") != before("v")) | (F.col("band") == before("band"))
    runs = runs.withColumn("__b", F.when(breaks, 1).otherwise(0)).withColumn("__c", F.sum("__b").over(chain.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.withColumn("whole", F.sum("n").over(W.partitionBy("source", "__c"))).where((F.col("whole") >= least) & F.col("v").isNotNull())
    long_edges = runs.select(F.col("source").alias("__s"), F.col("band").alias("__bd"), F.col("run").alias("__r"))
    joined = kept.join(long_edges, F.col("source").eqNullSafe(F.col("__s")) & (F.col("band") == F.col("__bd")) & (F.col("run") == F.col("__r")), "left")
    return joined.where(F.col("v").isNotNull() & ((F.col("n") >= least) | F.col("__r").isNotNull())).select("source", *cols)


def delivered(df: DataFrame, flagged: DataFrame, source: str, order: Sequence[str], row_id: str) -> DataFrame:
    """``record_id`` of all rows of ``df``, repeats included, at a flagged source and position."""
    flagged = scratch(flagged.select("source", *[f"o{k}" for k in range(len(order))], "lone").distinct())
    small = broadcast_if_small(flagged, flagged.count())
    lone = F.lit(False)
    rows = df.select(F.col(row_id).alias("record_id"), F.col(source).alias("__src"), *[F.col(c).cast("long").alias(f"__o{k}") for k, c in enumerate(order)])
    cond = rows["__src"].eqNullSafe(small["source"])
    for k in range(len(order)):
        cond = cond & rows[f"__o{k}"].eqNullSafe(small[f"o{k}"])
        lone = lone | rows[f"__o{k}"].isNull()
    rows_lone = F.when(lone, F.col("record_id"))
    return rows.join(small, cond & rows_lone.eqNullSafe(small["lone"]), "left_semi").select("record_id")


@dataclass(frozen=True)
class Reading:
    """One measured column: its rule, stuck-run length (0: exempt) and the condition of the physically impossible."""

    rule: SpikeRule
    stuck: int
    impossible: str


def odd_readings(df: DataFrame, *, row_id: str, source: str, order: Sequence[str], band: int, readings: dict[str, Reading], needed: Sequence[str] = (), season: Column | None = None) -> DataFrame:
    """``source, o0.., lone, reading, case`` of every odd distinct reading.

    Cases: ``peak`` (a candidate of the tail within the exact rule), ``spike`` (a candidate farther from the
    source's median than ``rule.far`` spreads), ``stuck`` and ``impossible``. ``needed`` are further columns
    the conditions use, ``season`` numbers the seasons. Missing and NaN readings are no cases; repeated
    deliveries count once; an empty table gives no rows; a source with one reading has no spread and so the
    floor. One pass of levels and tails serves all readings of the table.
    """
    values = {c: F.col(c) for c in [*readings, *needed]}
    base = scratch(distinct_readings(df, source, order, values, row_id, season))
    cols = ["source", *[f"o{k}" for k in range(len(order))], "lone"]
    rules = {name: r.rule for name, r in readings.items()}
    far = F.abs(F.col("v") - F.col("centre")) > _by_reading(rules, "far") * F.col("spread")
    out = candidates(base.select(*cols, "season", *readings), rules).select(*cols, "reading", F.when(far, F.lit("spike")).otherwise(F.lit("peak")).alias("case"))
    for name, reading in readings.items():
        parts = [base.where(F.expr(reading.impossible)).select(*cols, F.lit("impossible").alias("case"))]
        if reading.stuck:
            parts.append(stuck(base, name, len(order), band, reading.stuck).withColumn("lone", F.lit(None).cast(base.schema["lone"].dataType)).select(*cols, F.lit("stuck").alias("case")))
        for part in parts:
            out = out.unionByName(part.withColumn("reading", F.lit(name)))
    return out
