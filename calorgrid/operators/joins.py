"""Joins with checked cardinality, pairings in time, grid look-ups and overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from calorgrid.functions.geo import overlap


class CardinalityError(ValueError):
    """A side of a checked join has a repeated key."""


def repeated_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).count().where("count > 1")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", left_unique: bool = True) -> DataFrame:
    """An equi-join whose right side (and left side, if asked) must have each key once, else :class:`CardinalityError`."""
    for side, name, wanted in ((right, "right", True), (left, "left", left_unique)):
        if wanted and not repeated_keys(side, on).isEmpty():
            raise CardinalityError(f"the {name} side repeats a key of {list(on)}")
    return left.join(right, list(on), how)


def pair_in_time(left: DataFrame, right: DataFrame, *, key: str, left_id: str, right_id: str, at: str, tolerance_s: float) -> DataFrame:
    """``left_id, right_id, n_candidates, gap_s`` for every left row: the right row of the same key within the tolerance if it is the only one.

    Times are matched in buckets of the tolerance, so a key's rows meet only their neighbours in time and a
    busy key is spread over its buckets. Several candidates or none leave ``right_id`` null.
    """
    width = max(1, int(tolerance_s * 1_000_000))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lhs = left.select(F.col(key).alias("__k"), F.col(left_id).alias(left_id), micros(at).alias("__t"))
    rhs = right.select(F.col(key).alias("__rk"), F.col(right_id).alias(right_id), micros(at).alias("__u"))
    lb = lhs.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("__t") / width) + d)))
    rb = rhs.withColumn("__rb", F.floor(F.col("__u") / width))
    apart = F.abs(F.col("__t") - F.col("__u"))
    hit = lb.join(rb, (F.col("__k") == F.col("__rk")) & (F.col("__b") == F.col("__rb")) & (apart <= width))
    found = hit.groupBy(F.col(left_id).alias("__l")).agg(F.count("*").alias("n"), F.first(right_id).alias("__one"), F.first(apart).alias("__gap"))
    one = F.col("n") == 1
    out = lhs.join(found, lhs[left_id] == found["__l"], "left")
    return out.select(left_id, F.when(one, F.col("__one")).alias(right_id), F.coalesce("n", F.lit(0).cast("long")).alias("n_candidates"), F.when(one, F.col("__gap") / 1e6).alias("gap_s"))


def pair_two_stage(files: DataFrame, *, folder: str, base: str, sample: str, role: str, path: str) -> DataFrame:
    """``stage, folder, key, visible, thermal, status``: pairs by equal base name, what is left by sample number.

    A base with exactly one visible and one thermal file is paired and consumed; the rest is grouped by
    folder and sample number, ``ok`` if again one of each, else ``duplicate`` or ``missing_visible`` /
    ``missing_thermal``.
    """
    v, t = F.when(F.col(role) == "V", F.col(path)), F.when(F.col(role) == "T", F.col(path))
    sides = (F.count(v).alias("nv"), F.count(t).alias("nt"), F.min(v).alias("visible"), F.min(t).alias("thermal"))
    stage1 = files.groupBy(folder, base).agg(*sides).where("nv = 1 and nt = 1")
    rest = files.join(stage1.select(folder, base), [folder, base], "left_anti")
    status = F.when((F.col("nv") > 1) | (F.col("nt") > 1), "duplicate").when(F.col("nv") == 0, "missing_visible").when(F.col("nt") == 0, "missing_thermal").otherwise("ok")
    stage2 = rest.groupBy(folder, sample).agg(*sides)
    one = lambda n, c: F.when(F.col(n) == 1, F.col(c)).alias(c)
    first = stage1.select(F.lit("base").alias("stage"), F.col(folder).alias("folder"), F.col(base).cast("string").alias("key"), "visible", "thermal", F.lit("ok").alias("status"))
    second = stage2.select(F.lit("sample").alias("stage"), F.col(folder).alias("folder"), F.col(sample).cast("string").alias("key"), one("nv", "visible"), one("nt", "thermal"), status.alias("status"))
    return first.unionByName(second)


def grid_lookup(points: DataFrame, cells: DataFrame, *, x: str, y: str, step: float, origin: tuple[float, float], cell_x: str, cell_y: str, take: Sequence[str]) -> DataFrame:
    """Left join of points to the cell of a regular grid that holds them, by computed row and column."""
    index = lambda c, o: F.floor((F.col(c) - o) / step).cast("long")
    keyed = cells.select(index(cell_x, origin[0] - step / 2).alias("__cx"), index(cell_y, origin[1] - step / 2).alias("__cy"), *take).dropDuplicates(["__cx", "__cy"])
    p = points.withColumn("__px", index(x, origin[0])).withColumn("__py", index(y, origin[1]))
    return p.join(keyed, (p["__px"] == keyed["__cx"]) & (p["__py"] == keyed["__cy"]), "left").drop("__px", "__py", "__cx", "__cy")


def overlapping(a: DataFrame, b: DataFrame, *, a_box: tuple[str, str, str, str], b_box: tuple[str, str, str, str], tile: float) -> DataFrame:
    """Pairs of rectangles (``min_x, max_x, min_y, max_y``) that share an area, with ``overlap_area``.

    Both sides are laid on tiles; a pair is taken in the tile that holds the lower left corner of the overlap.
    """
    def tiled(df: DataFrame, box: tuple[str, str, str, str], tag: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / tile).cast("long"), F.floor(F.col(hi) / tile).cast("long"))
        return df.withColumn(f"__{tag}x", F.explode(span(box[0], box[1]))).withColumn(f"__{tag}y", F.explode(span(box[2], box[3])))

    p = tiled(a, a_box, "a").join(tiled(b, b_box, "b"), (F.col("__ax") == F.col("__bx")) & (F.col("__ay") == F.col("__by")))
    w = overlap(F.col(a_box[0]), F.col(a_box[1]), F.col(b_box[0]), F.col(b_box[1]))
    h = overlap(F.col(a_box[2]), F.col(a_box[3]), F.col(b_box[2]), F.col(b_box[3]))
    corner: Column = (F.floor(F.greatest(F.col(a_box[0]), F.col(b_box[0])) / tile) == F.col("__ax")) & (F.floor(F.greatest(F.col(a_box[2]), F.col(b_box[2])) / tile) == F.col("__ay"))
    return p.where((w > 0) & (h > 0) & corner).withColumn("overlap_area", w * h).drop("__ax", "__ay", "__bx", "__by")


def in_windows(df: DataFrame, at: str, windows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows once per (id, start, end) window that holds them, both ends inside; windows may overlap."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    hits = [F.when(t.between(F.unix_micros(F.lit(a).cast("timestamp")), F.unix_micros(F.lit(b).cast("timestamp"))), F.lit(name)) for name, a, b in windows]
    return df.withColumn("window_id", F.explode(F.array_compact(F.array(*hits))))


def unique_fallback(left: DataFrame, right: DataFrame, *, exact: Sequence[str], loose: str, value: str) -> DataFrame:
    """``value`` of the exact key, else of the loose key if all its rows agree, with ``match``: exact, unique, ambiguous or missing."""
    e = right.groupBy(*exact).agg(F.min(value).alias("__e"))
    u = right.groupBy(loose).agg(F.count_distinct(value).alias("__n"), F.min(value).alias("__u"))
    out = left.join(e, list(exact), "left").join(u, loose, "left")
    match = F.when(F.col("__e").isNotNull(), "exact").when(F.col("__n") == 1, "unique").when(F.col("__n") > 1, "ambiguous").otherwise("missing")
    return out.withColumn("match", match).withColumn(value, F.coalesce("__e", F.when(F.col("__n") == 1, F.col("__u")))).drop("__e", "__n", "__u")


def match_by_key_or_place(requests: DataFrame, results: DataFrame, *, key: str, place: str, value: str) -> DataFrame:
    """The requests with the result of the same key, else (where no result has the key) of the same place; ``found_by`` is key, place or missing."""
    by_key = results.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(value).alias("__v"))
    by_place = results.where(F.col(key).isNull()).groupBy(F.col(place).alias("__p")).agg(F.min(value).alias("__w"))
    out = requests.join(by_key, requests[key] == by_key["__k"], "left").join(by_place, requests[place] == by_place["__p"], "left")
    how = F.when(F.col("__k").isNotNull(), "key").when(F.col("__p").isNotNull(), "place").otherwise("missing")
    return out.withColumn("found_by", how).withColumn(value, F.when(F.col("__k").isNotNull(), F.col("__v")).otherwise(F.col("__w"))).drop("__k", "__v", "__p", "__w")


def lookup_or_fail(df: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """An inner look-up that must find every row: keys without an entry are named in the error, none is invented."""
    lost = df.select(*on).distinct().join(dimension, list(on), "left_anti").limit(3).collect()
    if lost:
        raise CardinalityError(f"no entry for {[tuple(r) for r in lost]}")
    return checked_join(df, dimension, on, "inner", left_unique=False)
