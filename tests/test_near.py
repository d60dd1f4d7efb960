import math
import random

import pytest

from calorgrid.operators import near

SCHEMA = "id long, img string, lat double, lon double, kind string"
CELLS = "key long, s double, n double, w double, e double, id string"


def run(spark, points, cells=(), distance=12.0):
    p = spark.createDataFrame([(*x, "clash") for x in points], SCHEMA)
    c = spark.createDataFrame([(*x, "clash") for x in cells], CELLS)
    out = near.near_or_inside(p, c, point_id="id", group="img", lat="lat", lon="lon", distance_m=distance, region_id="key", bounds=("s", "n", "w", "e")).collect()
    return sorted((r.relation, r.left_id, r.right_id) for r in out)


def brute(points, cells=(), distance=12.0):
    ok = [p for p in points if p[2] is not None and p[3] is not None and not math.isnan(p[2]) and not math.isnan(p[3]) and abs(p[2]) <= 90 and abs(p[3]) <= 180 and (p[2], p[3]) != (0, 0)]
    out = set()
    for i, a in enumerate(ok):
        for b in ok[i + 1 :]:
            if a[0] != b[0] and a[1] != b[1] and near._metres(a[2], a[3], b[2], b[3]) <= distance:
                out.add(("near", min(a[0], b[0]), max(a[0], b[0])))
        for k, s, n, w, e in cells:
            if None not in (s, n, w, e) and s <= a[2] < n and (w <= a[3] < e if w <= e else a[3] >= w or a[3] < e):
                out.add(("inside", a[0], k))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_random_places_meridian_and_poles(spark, seed):
    rng = random.Random(seed)
    points = []
    for base in ((22.3, 114.0), (-16.5, 179.99995), (0.0, 0.0), (89.9999, 10.0), (-89.99995, -170.0)):
        for _ in range(60):
            lon = (base[1] + rng.uniform(-4e-4, 4e-4) * (400 if abs(base[0]) > 89 else 1) + 180) % 360 - 180
            points.append((len(points), f"i{rng.randrange(40)}", min(90.0, max(-90.0, base[0] + rng.uniform(-3e-4, 3e-4))), lon))
    cells = [(1000 + k, 22.3 - 3e-4 + 1e-4 * k, 22.3 - 2e-4 + 1e-4 * k, 113.9997, 114.0003) for k in range(6)] + [(2000, -16.5003, -16.4997, 179.9998, -179.9998)]
    assert run(spark, points, cells) == brute(points, cells)


def test_wide_regions(spark):
    points = [(1, "a", 10.0, 20.0), (2, "b", -40.0, 175.0), (3, "c", 10.5, 20.5)]
    cells = [(7, 0.0, 30.0, 0.0, 60.0), (8, -60.0, 0.0, 170.0, -170.0), (9, 9.99999, 10.00001, 19.99999, 20.00001)]
    assert run(spark, points, cells) == brute(points, cells)


def test_no_places_nulls_ties_and_repeats(spark):
    nan = float("nan")
    points = [(1, "a", 0.0, 0.0), (2, "b", None, 1.0), (3, "c", nan, 1.0), (4, "d", 91.0, 1.0), (5, "e", 1.0, 181.0), (6, "f", 5.0, 5.0), (7, "g", 5.0, 5.0), (7, "g", 5.0, 5.0), (8, "f", 5.0, 5.0)]
    assert run(spark, points, [(1, None, 2.0, 3.0, 4.0)]) == [("near", 6, 7), ("near", 7, 8)]
    assert run(spark, [(1, None, 5.0, 5.0), (2, None, 5.0, 5.0), (3, "x", 5.0, 5.0)]) == [("near", 1, 3), ("near", 2, 3)]


def test_bounds_and_repeated_regions(spark):
    cells = [(1, 5.0, 6.0, 5.0, 6.0), (1, 5.0, 6.0, 5.0, 6.0)]
    points = [(1, "a", 5.0, 5.0), (2, "b", 6.0, 5.5), (3, "c", 5.5, 6.0)]
    assert run(spark, points, cells) == [("inside", 1, 1)]


def test_empty(spark):
    assert run(spark, []) == []


def test_crowded_pieces_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_ROWS", 10)
    rng = random.Random(5)
    points = [(k, f"i{k}", 22.3 + rng.uniform(0, 3e-4), 114.0 + rng.uniform(0, 3e-4)) for k in range(120)]
    cells = [(1, 22.3, 22.3002, 114.0, 114.0002)]
    assert run(spark, points, cells) == brute(points, cells)
