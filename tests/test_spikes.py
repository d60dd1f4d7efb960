import random

import numpy as np
from pyspark.sql import functions as F

from calorgrid.operators import spikes as S

SCHEMA = "id long, src string, r int, c int, v float, case string, spread string"
READINGS = {"v": S.Reading(S.SpikeRule(0.2), 8, "v < -273.15")}


def run(spark, rows, band=4):
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], SCHEMA)
    odd = S.odd_readings(df, row_id="id", source="src", order=["r", "c"], band=band, readings=READINGS)
    cases = {}
    for r in odd.collect():
        cases.setdefault((r["source"], r["o0"], r["o1"]), set()).add(r["case"])
    rows = {r["record_id"] for r in S.delivered(df, odd.where("case != 'peak'"), "src", ["r", "c"], "id").collect()}
    return cases, rows


def brute(rows):
    once, out = {}, set()
    for i, s, r, c, v, in rows:
        if r is None or c is None:
            once[s, r, c, i] = v
        else:
            once.setdefault((s, r, c, None), v)
    for s in {k[0] for k in once}:
        own = {k: v for k, v in once.items() if k[0] == s}
        fine = [float(np.float32(v)) for v in own.values() if v is not None and v == v]
        if not fine:
            continue
        q = np.quantile(fine, [0.25, 0.5, 0.75])
        far = {k for k, v in own.items() if v is not None and v == v and abs(float(np.float32(v)) - q[1]) > 5 * max(0.2, q[2] - q[0])}
        cold = {k for k, v in own.items() if v is not None and v < -273.15}
        seq, run, held = sorted((k for k in own if k[1] is not None and k[2] is not None), key=lambda k: k[1:3]), [], set()
        for k in [*seq, None]:
            v = own[k] if k else None
            if run and k and v is not None and v == v and own[run[-1]] == v:
                run.append(k)
                continue
            if len(run) >= 8:
                held |= set(run)
            run = [k] if k and v is not None and v == v else []
        out |= far | cold | held
    return {i for i, s, r, c, v in rows if (s, r, c, i if r is None or c is None else None) in out}


def test_cases_with_a_hot_source_and_repeats(spark):
    rng = random.Random(2)
    rows = []
    for k in range(1500):
        s = "hot" if rng.random() < 0.5 else f"s{rng.randrange(6)}"
        v = rng.gauss(20, 1) if rng.random() > 0.02 else rng.choice([None, float("nan"), 300.0, -300.0, -40.0])
        rows.append((k, s, rng.randrange(30), rng.randrange(30), v))
    seen = {}
    rows = [(i, s, r, c, seen.setdefault((s, r, c), v)) for i, s, r, c, v in rows]
    rows += [(5000 + k, "stuck", k // 3, k % 3, 7.25 if 4 <= k < 17 else float(k % 5)) for k in range(30)]
    rows += [(6000 + k, "stuck", 2, 0, 7.25) for k in range(3)]
    rows += [(7000, "hot", None, 3, 900.0), (7001, "hot", None, 3, 20.0), (7002, None, 1, 1, 1.0), (7003, None, 1, 2, 99.0)]
    cases, got = run(spark, rows)
    assert got == brute(rows)
    assert "stuck" in cases["stuck", 3, 0] and {6000, 6001, 6002} <= got


def tails(spark, rows, **rule):
    """Candidates of one reading from (source, position, season, value)."""
    df = spark.createDataFrame(rows, "source string, o0 long, season int, v double")
    return {(r["source"], r["o0"]): r for r in S.candidates(df, {"v": S.SpikeRule(0.2, **rule)}).collect()}


def test_tail_cutoff_flags_beyond_the_fitted_tail(spark):
    rng = np.random.default_rng(3)
    rows = [("a", k, 0, float(v)) for k, v in enumerate(rng.normal(0, 1, 5000))] + [("a", 9999, 0, 6.0), ("a", 9998, 0, float("inf"))]
    got = tails(spark, rows)
    assert ("a", 9999) in got and ("a", 9998) in got and len(got) <= 5
    assert 3 < got["a", 9999]["cutoff"] < 6


def test_tails_are_fitted_apart_and_recover_the_law(spark):
    """Exponential excesses above (shape 0, scale 1) and short ones below; quartiles held by a wide middle."""
    rng = np.random.default_rng(5)
    middle = np.linspace(-1, 1, 20_000)
    up, down = 3 + rng.exponential(1.0, 2000), -3 - rng.random(2000) * 0.5
    rows = [("a", k, 0, float(v)) for k, v in enumerate(np.concatenate([middle, up, down]))]
    df = spark.createDataFrame(rows, "source string, o0 long, season int, v double")
    rules = {"v": S.SpikeRule(0.2, peak=3 / 1.1, far=12.0)}
    peaks = S.residuals(df, rules).withColumn("residual", F.col("v") - F.col("level")).withColumn("start", F.lit(3.0)).where("abs(residual) > 3")
    beyond = {r["upper"]: r["beyond"] for r in S.fitted_tails(peaks, rules).collect()}
    # an exponential law exceeds ln(share of peaks / half the risk)
    assert abs(beyond[True] - np.log(2000 / 24_000 / 5e-5)) < 1.0
    assert 0.35 < beyond[False] < 0.75


def test_seasons_take_their_level_away(spark):
    rng = np.random.default_rng(4)
    rows = [("a", k, k % 2, float(4 * (k % 2) + v)) for k, v in enumerate(rng.normal(0, 0.3, 4000))]
    rows += [("a", 9000, 0, 4.0), ("a", 9001, 1, 4.0)]
    got = tails(spark, rows)
    assert ("a", 9000) in got and ("a", 9001) not in got


def test_no_reading_of_the_exact_rule_is_lost(spark):
    """A season of odd readings only has its level among them, and still they are candidates."""
    rng = np.random.default_rng(6)
    rows = [("a", k, 0, float(v)) for k, v in enumerate(rng.normal(0, 1, 500))] + [("a", 1000 + k, 1, 12.0 + k) for k in range(5)]
    rows += [("b", k, k % 24, float(v)) for k, v in enumerate(rng.standard_cauchy(800))]
    got = tails(spark, rows)
    for s in "ab":
        v = np.array([x[3] for x in rows if x[0] == s])
        q = np.quantile(v, [0.25, 0.5, 0.75])
        far = {x[1] for x in rows if x[0] == s and abs(x[3] - q[1]) > 5 * max(0.2, q[2] - q[0])}
        assert far and far <= {k for t, k in got if t == s}


def test_empty(spark):
    assert run(spark, []) == ({}, set())
    assert run(spark, [(1, "a", 0, 0, None)]) == ({}, set())
