import numpy as np
import pytest
from pyspark.sql import functions as F

from calorgrid.llm import quantiles as Q

PROBS = {"a": 0.05, "m": 0.5, "z": 0.95}


def build(values, eps):
    v = np.sort(values)
    r = np.arange(1, len(v) + 1)
    return Q.compress(v, r, r, len(v), eps)


@pytest.mark.parametrize("eps", [0.0, 0.002, 0.02])
def test_merged_bounds_hold_and_error_is_tracked(eps):
    rng = np.random.default_rng(5)
    parts = [np.round(rng.normal(k % 3, 1 + k, rng.integers(1, 900)), 1) for k in range(40)]
    level = [build(p, eps / 4) for p in parts]
    sizes = [len(p) for p in parts]
    while len(level) > 1:  # hierarchical, a few at a time
        merged, n = [], []
        for k in range(0, len(level), 6):
            some = level[k : k + 6]
            m = Q.merge(*(np.concatenate([s[i] for s in some]) for i in range(3)), np.array([len(s[0]) for s in some]))
            n.append(sum(sizes[k : k + 6]))
            merged.append(Q.compress(*m, n[-1], eps / 4))
        level, sizes = merged, n
    v, lo, hi = level[0]
    every = np.sort(np.concatenate(parts))
    for value, a, b in zip(v, lo, hi):
        first, last = np.searchsorted(every, value, "left") + 1, np.searchsorted(every, value, "right")
        assert a <= last and b >= first
    assert Q.rank_error(lo, hi) <= eps * len(every) + 1
    for p in (0, 0.01, 0.05, 0.3, 0.5, 0.95, 1):
        low, high = Q.bounds(v, lo, hi, len(every), p)
        assert low - 1e-12 <= np.quantile(every, p) <= high + 1e-12
        if eps == 0.0:
            assert low == pytest.approx(high) == pytest.approx(np.quantile(every, p))


def summaries(spark, rows, eps, chunk=Q.CHUNK):
    """Rows are (key, within, value), each a position of its own, or (key, within, value, position)."""
    df = spark.createDataFrame([(*r[:3], r[3] if len(r) > 3 else k, 1) for k, r in enumerate(rows)], "k string, part string, v float, p int, n int")
    return Q.summaries(Q.packed(df, ["k"], "part", F.col("p"), F.col("v")), ["k"], "part", eps, chunk)


def test_frame_with_hot_key_nulls_and_ties(spark):
    rng = np.random.default_rng(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.integers(5)}", f"c{rng.integers(200)}", float(np.round(rng.normal(), 2))) for _ in range(6000)]
    rows += [(None, "x", 1.0), (None, "y", 3.0), ("void", "x", None), ("void", "x", float("nan")), ("void", "x", float("inf")), ("one", None, 4.0)] + [("same", "c", 2.5)] * 300
    for chunk, most in ((Q.CHUNK, 1), (40, 200), (40, 5000)):  # whole, and split with two and three levels
        parts = summaries(spark, rows, 0.005, chunk)
        got = {r["k"]: r for r in Q.percentiles(Q.merge_levels(parts, ["k"], "__part", 0.01, most), ["k"], PROBS).collect()}
        assert set(got) == {k for k, *_ in rows} - {"void"}
        for k, r in got.items():
            v = np.array([np.float32(x) for q, _, x in rows if q == k and x is not None and np.isfinite(x)], dtype=float)
            assert r["n"] == len(v) and r["rank_error"] <= 0.015 * len(v) + 1
            for name, p in PROBS.items():
                assert r[f"{name}_low"] - 1e-9 <= np.quantile(v, p) <= r[f"{name}_high"] + 1e-9


def test_parts_of_different_days_combine(spark):
    rows = [("k", f"d{i % 3}", float(i)) for i in range(90)]
    days = [summaries(spark, [r for r in rows if r[1] == f"d{d}"], 0.0) for d in range(3)]
    days = days[0].unionByName(days[1]).unionByName(days[2])
    r = Q.percentiles(Q.merge_by(days, ["k"], 0.0), ["k"], PROBS).first()
    assert (r["m_low"], r["m_high"], r["rank_error"], r["n_tuples"]) == (44.5, 44.5, 0, 90)


def test_copies_of_a_position_count_once(spark):
    rows = [("k", f"c{i % 3}", float(i), i // 3) for i in range(60)]
    got = Q.percentiles(summaries(spark, rows + rows[::-1] + rows[:7], 0.0).drop("__part"), ["k"], PROBS).first()
    assert got["n"] == 60 and got["m_low"] == got["m_high"] == 29.5


def test_long_streams_are_merged_in_levels_within_the_error(monkeypatch):
    monkeypatch.setattr(Q, "LEAF", 100)
    rng = np.random.default_rng(9)
    values = rng.normal(size=5000)
    s = Q._Summary(0.01)
    for part in np.array_split(values, 173):
        s.add(part)
    v, lo, hi, n = s.result()
    assert n == 5000 and len(v) <= 103
    assert 0 < Q.rank_error(lo, hi) <= 0.01 * n * 7  # one share per level
    for p in PROBS.values():
        low, high = Q.bounds(v, lo, hi, n, p)
        assert low <= np.quantile(values, p) <= high


def test_empty(spark):
    parts = summaries(spark, [], 0.01)
    assert Q.percentiles(Q.merge_levels(parts, ["k"], "__part", 0.01, 1), ["k"], PROBS).count() == 0
