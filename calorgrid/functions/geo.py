"""Geometry of footprints, grids and polygons as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_M = 6_371_008.8
#: Diagonal of a full-frame sensor in millimetres (36 x 24).
FULL_FRAME_MM = math.hypot(36, 24)


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    a, b = F.radians(lat_a), F.radians(lat_b)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def field_of_view(focal: Column, sensor: Column) -> Column:
    return F.degrees(2 * F.atan(sensor / (2 * focal)))


def sensor_size(focal: Column, focal_35: Column, side: Column, other: Column) -> Column:
    """Sensor length along ``side`` pixels from the 35 mm equivalent."""
    return FULL_FRAME_MM / (focal_35 / focal) * side / F.hypot(side, other)


def ground_length(height: Column, fov: Column) -> Column:
    return 2 * height * F.tan(F.radians(fov) / 2)


def overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))


def grid_index(origin: float, c: Column, step: float) -> Column:
    return F.floor((c - origin) / step).cast("long")


def shoelace(xs: Column, ys: Column) -> Column:
    """Signed area of a polygon given by arrays of its vertices."""
    n = F.size(xs)
    turn = F.transform(F.sequence(F.lit(0), n - 1), lambda i: xs[i] * ys[(i + 1) % n] - xs[(i + 1) % n] * ys[i])
    return F.when(n < 3, F.lit(0.0)).otherwise(F.aggregate(turn, F.lit(0.0), lambda a, b: a + b) / 2)


def valid_polygon(xs: Column, ys: Column) -> Column:
    """At least three finite vertices that span an area."""
    fine = F.forall(F.concat(xs, ys), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (F.size(xs) == F.size(ys)) & (F.size(xs) >= 3) & fine & (F.abs(shoelace(xs, ys)) >= 1e-6)


def inside_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule; a pixel belongs to the polygon if its centre does, so the outline itself is not drawn."""
    odd = F.lit(False)
    for (x0, y0), (x1, y1) in zip(vertices, vertices[1:] + vertices[:1]):
        if y0 == y1:
            continue
        crosses = (F.lit(y0) > y) != (F.lit(y1) > y)
        hit = crosses & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
        odd = odd != hit
    return odd


def map_to_pixel(v: Column, low: Column, high: Column, pixels: Column) -> Column:
    return (v - low) / (high - low) * pixels


#: Ellipsoids as (semi-major axis in m, inverse flattening): WGS 84 and International 1924 (fixed values).
WGS84, INTERNATIONAL = (6_378_137.0, 298.257223563), (6_378_388.0, 297.0)
#: Hong Kong 1980 to WGS 84: shifts in m, rotations in arc seconds (position vector), scale in ppm (fixed values).
HK80_SHIFT = (-162.619, -276.959, -161.764, 0.067753, -2.24365, -1.15883, -1.09425)
#: Hong Kong 1980 grid: origin latitude and longitude in degrees, false easting and northing in m (fixed values).
HK80_GRID = (22.312133333333334, 114.17855555555556, 836_694.05, 819_069.80)


def _meridian(lat: Column | float, a: float, e2: float, sin) -> Column | float:
    """Length of the meridian from the equator."""
    c0 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256
    c2 = 3 / 8 * (e2 + e2**2 / 4 + 15 * e2**3 / 128)
    c4 = 15 / 256 * (e2**2 + 3 * e2**3 / 4)
    c6 = 35 * e2**3 / 3072
    return a * (c0 * lat - c2 * sin(2 * lat) + c4 * sin(4 * lat) - c6 * sin(6 * lat))


def hong_kong_grid(lat: Column, lon: Column) -> Column:
    """``easting, northing`` in metres of the Hong Kong 1980 grid for WGS 84 degrees at height 0.

    Datum by the inverse of the published seven parameters, projection by the usual transverse Mercator
    series; good to about a metre around the territory.
    """
    a, f = WGS84[0], 1 / WGS84[1]
    e2 = f * (2 - f)
    phi, lam = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    x, y, z = n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1 - e2) * F.sin(phi)
    dx, dy, dz, rx, ry, rz, ppm = HK80_SHIFT
    rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
    k = 1 / (1 + ppm * 1e-6)
    u, v, w = (x - dx) * k, (y - dy) * k, (z - dz) * k
    x, y, z = u + rz * v - ry * w, -rz * u + v + rx * w, ry * u - rx * v + w
    a, f = INTERNATIONAL[0], 1 / INTERNATIONAL[1]
    e2 = f * (2 - f)
    b, ep2 = a * (1 - f), e2 / (1 - e2)
    p = F.hypot(x, y)
    t = F.atan2(z * a, p * b)
    phi = F.atan2(z + ep2 * b * F.pow(F.sin(t), 3), p - e2 * a * F.pow(F.cos(t), 3))
    lat0, lon0, east0, north0 = HK80_GRID
    d = F.atan2(y, x) - math.radians(lon0)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    tan2, c, q = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), d * F.cos(phi)
    east = east0 + n * (q + (1 - tan2 + c) * F.pow(q, 3) / 6 + (5 - 18 * tan2 + tan2 * tan2 + 72 * c - 58 * ep2) * F.pow(q, 5) / 120)
    arc = _meridian(phi, a, e2, F.sin) - _meridian(math.radians(lat0), a, e2, math.sin)
    north = north0 + arc + n * F.tan(phi) * (q * q / 2 + (5 - tan2 + 9 * c + 4 * c * c) * F.pow(q, 4) / 24)
    return F.struct(east.alias("easting"), north.alias("northing"))


def region_of_interest(fov_a: Column, fov_b: Column, width: Column, height: Column) -> Column:
    """Centred crop of an image of field of view ``fov_a`` that shows what one of ``fov_b`` does: ``x0, y0, w, h`` in pixels."""
    share = F.least(F.lit(1.0), F.tan(F.radians(fov_b) / 2) / F.tan(F.radians(fov_a) / 2))
    w, h = width * share, height * share
    return F.struct(((width - w) / 2).alias("x0"), ((height - h) / 2).alias("y0"), w.alias("w"), h.alias("h"))
