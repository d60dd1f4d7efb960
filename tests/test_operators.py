import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calorgrid.operators import alignment, describe as D, joins as J, quality as QA, ranks, temporal as T, thinning
from calorgrid.operators.prefix import prefix_sum


def test_prefix_sum(spark):
    rng = random.Random(1)
    vals = [(k, rng.randrange(100)) for k in range(500)]
    got = {r["k"]: r["b"] for r in prefix_sum(spark.createDataFrame(rng.sample(vals, 500), "k long, v long"), ["k"], {"b": F.col("v")}).collect()}
    assert [got[k] for k, _ in vals] == [0, *itertools.accumulate(v for _, v in vals)][:-1]


def test_allocate_matches_the_plain_loop():
    rng = random.Random(2)
    for _ in range(200):
        names = [f"i{k}" for k in range(rng.randrange(1, 9))]
        counts = {n: float(rng.randrange(1, 60)) for n in names}
        cap = {n: rng.randrange(1, int(counts[n]) + 1) for n in names}
        total = rng.randrange(len(names), 60)
        got = thinning.allocate(counts, cap, total)
        assert all(1 <= got[n] <= cap[n] for n in names) and sum(got.values()) == min(total, sum(cap.values()))
    assert thinning.allocate({"a": 50, "b": 50}, {"a": 50, "b": 50}, 11) == {"a": 5, "b": 6}
    assert thinning.allocate({"a": 97, "b": 2, "c": 1}, {"a": 97, "b": 2, "c": 1}, 4) == {"a": 2, "b": 1, "c": 1}
    # more strata than places: those of most pixels get one each
    assert thinning.allocate({"a": 5, "b": 9, "c": 9, "d": 1}, {"a": 5, "b": 9, "c": 9, "d": 1}, 3) == {"a": 1, "b": 1, "c": 1, "d": 0}


@pytest.mark.parametrize("seed", [0, 42])
def test_thinned_sample_against_plain_python(spark, seed):
    from test_functions import python_mix

    pixels = [(i, "paving" if c % 3 == 0 else "grass", r, c) for i, (h, w) in {"a": (17, 19), "b": (13, 23), "c": (11, 29)}.items() for r in range(h) for c in range(w)]
    base = {p[:1] + p[2:]: k for k, p in enumerate(sorted(pixels, key=lambda p: (p[0], p[2], p[3])))}
    best = {}
    for i, g, r, c in pixels:
        b = base[i, r, c]
        key = (i, g, r // 3, c // 3)
        best[key] = min(best.get(key, (1 << 65,)), (python_mix(b, seed), b, r, c))
    cand = {}
    for (i, g, *_), (_, b, r, c) in best.items():
        cand.setdefault((i, g), []).append((python_mix(b, seed ^ thinning.SECOND_SEED), b, r, c))
    cand = {k: sorted(v)[:19] for k, v in cand.items()}
    want = set()
    for g in ("grass", "paving"):
        mine = {i: v for (i, h), v in cand.items() if h == g}
        quota = thinning.allocate({i: float(sum(p[0] == i and p[1] == g for p in pixels)) for i in mine}, {i: len(v) for i, v in mine.items()}, 43)
        want |= {(g, i, r, c) for i, v in mine.items() for _, _, r, c in v[: quota[i]]}
    df = spark.createDataFrame(random.Random(3).sample(pixels, len(pixels)), "image_id string, group_name string, thermal_row int, thermal_col int")
    sample = thinning.thinned_sample(df, [seed], tile=3, per_image=19, per_group=43)
    assert {(r["group_name"], r["image_id"], r["thermal_row"], r["thermal_col"]) for r in sample.collect()} == want
    m = thinning.sampling_manifest(df, sample).collect()
    assert sum(r["sampled"] for r in m) == len(want) and sum(r["eligible"] for r in m) == len(pixels)


def test_rank_tests(spark):
    rng = np.random.default_rng(4)
    groups = {"a": np.round(rng.normal(0, 1, 200), 1), "b": np.round(rng.normal(0.3, 1, 150), 1), "c": np.round(rng.normal(0, 2, 90), 1)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(None, 1.0), ("a", None), ("b", float("nan"))]
    g, p = ranks.rank_statistics(spark.createDataFrame(rows, "g string, v double"), "g", "v")
    pairs = {(r["a"], r["b"]): r for r in ranks.mann_whitney(p).collect()}
    for a, b in itertools.combinations("abc", 2):
        x, y = groups[a][:, None], groups[b][None, :]
        u = (x > y).sum() + 0.5 * (x == y).sum()
        assert pairs[a, b]["u"] == pytest.approx(u)
        _, t = np.unique(np.concatenate([groups[a], groups[b]]), return_counts=True)
        n1, n2 = x.size, y.size
        sd = math.sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - (t**3 - t).sum() / ((n1 + n2) * (n1 + n2 - 1))))
        assert pairs[a, b]["p_value"] == pytest.approx(min(1, math.erfc(max(0, abs(u - n1 * n2 / 2) - 0.5) / sd / math.sqrt(2))))
        assert pairs[a, b]["effect"] == pytest.approx(2 * u / (n1 * n2) - 1)
    ps = sorted(r["p_value"] for r in pairs.values())
    adjusted = [min(min(1, q * 3 / (k + 1)) for k, q in list(enumerate(ps))[i:]) for i in range(3)]
    assert sorted(r["adjusted"] for r in pairs.values()) == pytest.approx(adjusted)
    every = np.concatenate(list(groups.values()))
    vals, inv, cnt = np.unique(every, return_inverse=True, return_counts=True)
    rank = (np.cumsum(cnt) - (cnt - 1) / 2)[inv]
    n, at, h = len(every), 0, 0.0
    for vs in groups.values():
        h += rank[at : at + len(vs)].sum() ** 2 / len(vs)
        at += len(vs)
    h = (12 / (n * (n + 1)) * h - 3 * (n + 1)) / (1 - (cnt**3.0 - cnt).sum() / (n**3 - n))
    k = ranks.kruskal_wallis(g).first()
    assert (k["statistic"], k["freedom"]) == (pytest.approx(h), 2) and k["p_value"] == pytest.approx(math.exp(-h / 2))


def test_describe_and_extremes(spark):
    df = spark.createDataFrame([("i", 0, 0, 1.0), ("i", 0, 1, 1.0), ("i", 0, 2, 2.0), ("i", 1, 0, 3.0), ("i", 1, 1, 9.0), ("i", 1, 2, 9.0), ("one", 0, 0, 4.0), ("nul", 0, 0, None)], "img string, r int, c int, v double")
    e = {r["img"]: r for r in D.extremes(df, ["img"], "v", "r", "c").collect()}
    assert (e["i"]["n_min_ties"], e["i"]["n_max_ties"], e["i"]["min_row"], e["i"]["min_col"], e["i"]["max_row"], e["i"]["max_col"]) == (2, 2, 0, 0, 1, 1)
    d = {r["img"]: r for r in D.describe(df, ["img"], F.col("v")).collect()}
    assert (d["one"]["sd"], d["one"]["median"], d["nul"]["n"], d["nul"]["median"]) == (0.0, 4.0, 0, None)


def test_joins(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(J.CardinalityError):
        J.checked_join(a, b, ["k"])
    assert J.checked_join(a, b.limit(1), ["k"]).count() == 2
    base = 1_700_000_000
    t = lambda s: F.timestamp_seconds(F.lit(base + s))
    left = spark.range(4).selectExpr("id as l", "'u' as k", f"timestamp_seconds({base} + id * 100) as at")
    right = spark.createDataFrame([(10, base + 3), (11, base + 103), (12, base + 95), (13, base + 209)], "r long, s long").selectExpr("r", "'u' as k", "timestamp_seconds(s) as at")
    got = {x["l"]: (x["r"], x["n_candidates"]) for x in J.pair_in_time(left, right, key="k", left_id="l", right_id="r", at="at", tolerance_s=10).collect()}
    assert got == {0: (10, 1), 1: (None, 2), 2: (13, 1), 3: (None, 0)}
    assert t(0) is not None


def test_components_and_grids(spark):
    art = ["##..#", "#...#", "..#..", ".#...", "#...#"]
    mask = [("i", r, c) for r, row in enumerate(art) for c, x in enumerate(row) if x == "#"]
    got = QA.component_sizes(spark.createDataFrame(mask + mask[:2], "i string, r int, c int"), "i", "r", "c").first()
    assert (got["n_pixels"], got["n_components"], got["largest"]) == (9, 4, 3)
    grid = [("a", r, c) for r in range(2) for c in range(3)] + [("b", 0, 0), ("b", 1, 1)] + [("c", 0, 0), ("c", 0, 0)]
    state = {r["i"]: r["state"] for r in QA.grid_completeness(spark.createDataFrame(grid, "i string, r int, c int"), "i", "r", "c").collect()}
    assert state == {"a": "complete", "b": "incomplete", "c": "duplicates"}


def test_series(spark):
    rows = [("cool", 2, 13.0, 16.0), ("hot", 12, 23.0, 26.0)]
    df = spark.createDataFrame(rows, "img string, h int, mean double, top double").selectExpr("img", "'s' as k", "timestamp_seconds(h * 3600) as at", "h", "mean", "top")
    r = {x["statistic"]: x for x in T.peak_to_trough(df, ["k"], "img", "at", {"mean": "mean", "max": "top"}).collect()}
    assert (r["mean"]["range"], r["mean"]["max_image"], r["mean"]["hours_between"], r["max"]["range"]) == (10.0, "hot", 10.0, 10.0)
    lone = T.peak_to_trough(df.where("h = 2"), ["k"], "img", "at", {"mean": "mean"}).first()
    assert lone["unavailable_reason"] == "fewer_than_two_compatible_captures" and lone["range"] is None
    day = spark.createDataFrame([(f"i{k}", 4 * k) for k in range(7)], "img string, h int").selectExpr("img", "'s' as k", "timestamp_seconds(h * 3600) as at", "h % 24 as h")
    assert T.sampling_coverage(day, ["k"], "img", "at", F.col("h"), True).first()["status"] == "full_day_sampling_design_confirmed"
    gap = T.sampling_coverage(day.where("img != 'i1'"), ["k"], "img", "at", F.col("h"), True).first()
    assert gap["gate_failures"] == "maximum_sampling_gap_exceeds_four_hours" and gap["largest_gap_hours"] == 8.0
    px = spark.createDataFrame([("x", 0, 0, 10.0), ("y", 0, 0, 11.0), ("x", 0, 1, 12.0), ("y", 0, 1, 15.0), ("x", 1, 1, 1.0)], "img string, r int, c int, v double")
    assert sorted((p["r"], p["c"], p["range"], p["max_image"]) for p in T.pixelwise_range(px, "img", "r", "c", "v", 2).collect()) == [(0, 0, 1.0, "y"), (0, 1, 3.0, "y")]


def test_lookups(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    with pytest.raises(J.CardinalityError):
        J.lookup_or_fail(spark.createDataFrame([(3,)], "k int"), a, ["k"])
    assert J.lookup_or_fail(spark.createDataFrame([(1,), (1,)], "k int"), a, ["k"]).count() == 2


def test_alignment(spark):
    true = np.array([[1.1, 0.05, 3.0], [-0.02, 0.9, -7.0], [0.0, 0.0, 1.0]])
    xy = np.random.default_rng(1).uniform(0, 100, (12, 2))
    uv = (true @ np.column_stack([xy, np.ones(12)]).T)[:2].T
    points = np.column_stack([xy, uv])
    assert np.allclose(alignment.affine(points), true) and np.allclose(alignment.homography(points), true, atol=1e-6)
    df = spark.createDataFrame([("a", *map(float, r)) for r in points] + [("b", 1.0, 2.0, 3.0, 4.0), ("a", None, 1.0, 1.0, 1.0)], "k string, x double, y double, u double, v double")
    rows = alignment.fit(df, "k").collect()
    assert [r["k"] for r in rows] == ["a"] and rows[0]["rmse"] < 1e-9
    box = spark.range(1).select(alignment.clamped_box(F.lit(-5.0), F.lit(500.0), F.lit(50.0), F.lit(0.2), (640, 512)).alias("b")).first()["b"]
    assert tuple(box) == (0, 500, 50, 501)


def test_edge_overlap_against_masks(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((30, 30)) < 0.05, rng.random((30, 30)) < 0.04
    rows = [("i", r, c, bool(a[r, c]), bool(b[r, c])) for r in range(30) for c in range(30)] + [("only", 1, 1, True, False), ("none", 1, 1, False, False)]
    got = {x["i"]: x for x in QA.edge_overlap(spark.createDataFrame(rows + rows[:40], "i string, r int, c int, a boolean, b boolean"), "i", "r", "c", F.col("a"), F.col("b")).collect()}

    def grown(m):
        out = np.zeros_like(m)
        for r, c in zip(*np.nonzero(m)):
            for i in range(-2, 3):
                for j in range(-2, 3):
                    if abs(i) + abs(j) <= 2 and 0 <= r + i < 30 and 0 <= c + j < 30:
                        out[r + i, c + j] = True
        return out

    p, q = (a & grown(b)).sum() / a.sum(), (b & grown(a)).sum() / b.sum()
    assert got["i"]["f1"] == pytest.approx(2 * p * q / (p + q)) and got["only"]["f1"] == 0.0 and "none" not in got


def test_correlation_of_what_does_not_vary(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", None, 1.0), ("b", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    assert {r["k"]: r["ncc"] for r in QA.correlation(df, ["k"], "x", "y").collect()} == {"a": pytest.approx(1.0), "b": 0.0, "c": 0.0}
