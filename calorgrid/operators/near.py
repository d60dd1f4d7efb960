"""Points near other points, and the regions that contain them.

Latitude is cut into strips that overlap by the search distance, each strip into longitude segments that
overlap likewise (at the 180th meridian the segments close to a ring). The pieces are range-partitioned
and sorted by latitude inside Spark; a task sweeps upward over its sorted rows with an active set ordered
by longitude. Every pair has one owner, the piece in which the lower point (by latitude, then id) is at
home, so it comes out once. Pieces that hold very many points are cut into blocks of owners that all see
the piece's points, so no task has to hold more than its share of owners; with n points in a piece that
copies n * n / BLOCK_ROWS rows, less than a thousandth of the pairs that so many points within a few
distances of each other have.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from calorgrid.runtime import broadcast_if_small, scratch

#: Mean Earth radius in metres (fixed value).
EARTH_M = 6_371_008.8
#: Strips are this many search distances high.
STRIP = 8
#: Owners swept by one block of a crowded piece.
BLOCK_ROWS = 50_000
POINT, REGION = 1, 0


def usable(lat: Column, lon: Column) -> Column:
    """Whether a coordinate is a place: present, a number, in range and not 0/0."""
    known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(known & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def _segments(strip: Column, step: float, reach: float) -> Column:
    """Number of longitude segments of a strip: each at least four reaches wide at the strip's narrowest parallel."""
    far = F.least(F.lit(90.0), F.greatest(F.abs(strip * step - 90), F.abs((strip + 1) * step - 90)) + 2 * reach)
    narrow = F.greatest(F.cos(F.radians(far)), F.lit(1e-12))
    return F.greatest(F.lit(1), F.floor(360 * narrow / (4 * STRIP * reach))).cast("long")


def _lon_reach(lat_far: Column, reach: float) -> Column:
    """Degrees of longitude within ``reach`` degrees of arc at the parallel ``lat_far`` or nearer the equator."""
    ratio = math.sin(math.radians(reach)) / F.greatest(F.cos(F.radians(lat_far)), F.lit(1e-15))
    return F.when(ratio >= 1, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))


def _wrap(segment: Column, n: Column) -> Column:
    return ((segment % n) + n) % n


def _pieces(points: DataFrame, step: float, reach: float) -> DataFrame:
    """Each point in its home piece and, as a visitor, in the pieces within reach below and beside it."""
    s = F.floor((F.col("lat") + 90) / step).cast("long")
    below = F.when((F.col("lat") + 90) - s * step <= reach * 1.001, F.array(s, s - 1)).otherwise(F.array(s))
    p = points.withColumn("home", s).withColumn("strip", F.explode(below))
    p = p.withColumn("__n", _segments(F.col("strip"), step, reach))
    at = (F.col("lon") + 180) / 360 * F.col("__n")
    far = F.least(F.lit(90.0), F.abs(F.col("lat")) + 2 * reach)
    wide = F.least(_lon_reach(far, reach) * 1.001 / 360 * F.col("__n"), F.col("__n") / 2 + 1)
    seg = F.array_distinct(F.transform(F.sequence(F.floor(at - wide).cast("long"), F.floor(at + wide).cast("long")), lambda x: _wrap(x, F.col("__n"))))
    p = p.withColumn("__own", _wrap(F.floor(at).cast("long"), F.col("__n"))).withColumn("seg", F.explode(seg))
    owner = (F.col("strip") == F.col("home")) & (F.col("seg") == F.col("__own"))
    return p.withColumn("owner", owner).drop("home", "__n", "__own")


def _region_pieces(regions: DataFrame, step: float, reach: float) -> DataFrame:
    """Each region in every piece that it overlaps."""
    first, last = F.floor((F.col("lat") + 90) / step).cast("long"), F.floor((F.col("lat_hi") + 90) / step).cast("long")
    r = regions.withColumn("strip", F.explode(F.sequence(first, last))).withColumn("__n", _segments(F.col("strip"), step, reach))
    a, b = ((F.col(c) + 180) / 360 * F.col("__n") for c in ("lon", "lon_hi"))
    seg = F.array_distinct(F.transform(F.sequence(F.floor(a).cast("long"), F.floor(b).cast("long")), lambda x: _wrap(x, F.col("__n"))))
    return r.withColumn("seg", F.explode(seg)).drop("__n")


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def _sweeper(distance: float, reach: float):
    """The sweep over rows sorted by piece, block, latitude, kind and id; state is carried from batch to batch."""

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece = last = None
        active: list = []  # owners, by longitude
        leave: deque = deque()  # the same owners, by latitude
        open_regions: list = []  # by western edge
        widest = 0.0
        seen: set = set()
        for pdf in batches:
            near_a, near_b, in_a, in_b = [], [], [], []
            rows = zip(*(pdf[c].tolist() for c in ("strip", "seg", "block", "kind", "id", "grp", "lat", "lon", "lat_hi", "lon_hi", "owner")))
            for strip, seg, block, kind, rid, grp, lat, lon, lat_hi, lon_hi, owner in rows:
                if (strip, seg, block) != piece:
                    piece, last, active, leave, open_regions, widest, seen = (strip, seg, block), None, [], deque(), [], 0.0, set()
                if kind == REGION:
                    if (rid, lat, lon, lat_hi, lon_hi) not in seen:
                        seen.add((rid, lat, lon, lat_hi, lon_hi))
                        insort(open_regions, (lon, lon_hi, lat_hi, rid, lat))
                        widest = max(widest, lon_hi - lon)
                    continue
                if (rid, lat, lon, grp) == last:
                    continue
                last = (rid, lat, lon, grp)
                if owner and open_regions:
                    shut = None
                    k = bisect_left(open_regions, (lon, math.inf)) - 1
                    while k >= 0 and open_regions[k][0] >= lon - widest:
                        w, e, n, key, s = open_regions[k]
                        if n <= lat:
                            shut = (shut or []) + [k]
                        elif lon < e:
                            in_a.append(rid)
                            in_b.append(key)
                        k -= 1
                    for k in shut or ():  # descending, so positions stay right
                        gone = open_regions.pop(k)
                        seen.discard((gone[3], gone[4], gone[0], gone[2], gone[1]))
                if distance >= 0:
                    while leave and lat - leave[0][0] > reach:
                        low = leave.popleft()
                        del active[bisect_left(active, (low[1], low[0], low[2]))]
                    if active:
                        c = math.cos(math.radians(min(90.0, abs(lat) + 2 * reach)))
                        ratio = math.sin(math.radians(reach)) / max(c, 1e-15)
                        dlon = 360.0 if ratio >= 1 else math.degrees(math.asin(ratio)) * 1.001
                        spans = [(-180.0, 180.0)] if dlon >= 180 else [(lon - dlon, lon + dlon)]
                        if dlon < 180 and lon - dlon < -180:
                            spans.append((lon - dlon + 360, 180.0))
                        if dlon < 180 and lon + dlon > 180:
                            spans.append((-180.0, lon + dlon - 360))
                        for w, e in spans:
                            k = bisect_left(active, (w,))
                            while k < len(active) and active[k][0] <= e:
                                olon, olat, oid, ogrp = active[k]
                                k += 1
                                if ogrp != grp and oid != rid and _metres(olat, olon, lat, lon) <= distance:
                                    near_a.append(min(oid, rid))
                                    near_b.append(max(oid, rid))
                    if owner:
                        insort(active, (lon, lat, rid, grp))
                        leave.append((lat, lon, rid))
            yield pd.DataFrame(
                {"relation": np.repeat(np.array(["near", "inside"], dtype=object), [len(near_a), len(in_a)]), "left_id": np.array(near_a + in_a, dtype="int64"), "right_id": np.array(near_b + in_b, dtype="int64")}
            )

    return sweep


def near_or_inside(points: DataFrame, regions: DataFrame | None, *, point_id: str, group: str | None, lat: str, lon: str, distance_m: float, region_id: str = "", bounds: tuple[str, str, str, str] | None = None, _reach: float | None = None) -> DataFrame:
    """``relation, left_id, right_id``: pairs of points at most ``distance_m`` apart, and points inside regions.

    ``('near', a, b)`` with ids a < b of points of different ``group``; ``('inside', point, region)`` where the
    region's bounds (``south, north, west, east`` columns; lower bound inside, upper outside; west > east
    crosses the 180th meridian) contain the point. Points that are not a :func:`usable` place, null ids and
    regions with a missing bound take no part; a null group differs from every named group but not from
    another null; a row repeated with the same id and place counts once; ties in latitude are ordered by
    id; empty inputs give no rows. Other columns are ignored, whatever their names.
    """
    reach = _reach or math.degrees(distance_m / EARTH_M) * (1 + 1e-9) + 1e-12
    step = reach * STRIP
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    p = points.where(usable(F.col(lat).cast("double"), F.col(lon).cast("double")) & F.col(point_id).isNotNull()).select(
        F.lit(POINT).alias("kind"), F.col(point_id).cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), g), F.lit("")).alias("grp"),
        F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat_hi"), F.lit(None).cast("double").alias("lon_hi"),
    )
    if not group:  # without groups every point is its own
        p = p.withColumn("grp", F.col("id").cast("string"))
    pieces = _pieces(p, step, reach)
    crowded = scratch(pieces.where("owner").groupBy("strip", "seg").count().where(F.col("count") > BLOCK_ROWS).select(F.col("strip").alias("__s"), F.col("seg").alias("__g"), F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")))
    n_crowded = crowded.count()
    if n_crowded:
        small = broadcast_if_small(crowded, n_crowded)
        joined = pieces.join(small, (pieces["strip"] == small["__s"]) & (pieces["seg"] == small["__g"]), "left").drop("__s", "__g")
        n = F.coalesce("blocks", F.lit(1))
        mine = F.pmod(F.xxhash64("id"), n).cast("int")
        pieces = joined.withColumn("block", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("owner", F.col("owner") & (F.col("block") == mine)).drop("blocks")
    else:
        pieces = pieces.withColumn("block", F.lit(0))
    coarse = None
    if regions is not None:
        south, north, west, east = (F.col(c).cast("double") for c in bounds)
        known = F.col(region_id).isNotNull()
        for b in (south, north, west, east):
            known = known & b.isNotNull() & ~F.isnan(b)
        one = F.struct(west.alias("w"), F.when(west > east, F.lit(180.0000001)).otherwise(east).alias("e"))
        two = F.struct(F.lit(-180.0).alias("w"), east.alias("e"))
        r = regions.where(known).select(F.col(region_id).cast("long").alias("id"), south.alias("lat"), north.alias("lat_hi"), F.explode(F.when(west > east, F.array(one, two)).otherwise(F.array(one))).alias("x"))
        r = r.where("lat < lat_hi and x.w < x.e").select(
            F.lit(REGION).alias("kind"), "id", F.lit("").alias("grp"), "lat", F.col("x.w").alias("lon"), "lat_hi", F.col("x.e").alias("lon_hi"), F.lit(False).alias("owner")
        )
        large = (F.col("lat_hi") - F.col("lat") > 8 * step) | (F.col("lon_hi") - F.col("lon") > 32 * step / F.greatest(F.lit(0.05), F.cos(F.radians("lat"))))
        if not r.where(large).isEmpty():  # wide regions are swept again in coarser pieces
            wide = r.where(large).select("id", "lat", "lat_hi", F.col("lon"), F.least("lon_hi", F.lit(180.0000001)).alias("lon_hi"))
            coarse = near_or_inside(points, wide, point_id=point_id, group=group, lat=lat, lon=lon, distance_m=-1.0, region_id="id", bounds=("lat", "lat_hi", "lon", "lon_hi"), _reach=reach * 32)
            r = r.where(~large)
        rp = _region_pieces(r, step, reach)
        if n_crowded:
            rp = rp.join(small, (rp["strip"] == small["__s"]) & (rp["seg"] == small["__g"]), "left").drop("__s", "__g")
            rp = rp.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        else:
            rp = rp.withColumn("block", F.lit(0))
        pieces = pieces.unionByName(rp)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["strip", "seg", "block", "lat", "kind", "id", "lon", "grp", "lat_hi", "lon_hi", "owner"]
    # written once: the range partitioning looks at a sample of its rows first
    ready = scratch(pieces.select(*cols)).repartitionByRange(parts, "strip", "seg", "block").sortWithinPartitions("strip", "seg", "block", "lat", "kind", "id", "lon", "grp")
    found = ready.mapInPandas(_sweeper(distance_m, reach), "relation string, left_id long, right_id long")
    return found if coarse is None else found.unionByName(coarse)
