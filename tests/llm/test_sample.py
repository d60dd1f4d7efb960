import hashlib
import math
import random
from pathlib import Path

import pytest

from calorgrid.llm import queries, sample

DATA = Path("/root/testdata/sf0.001")

RECORDS, STRATA = "g string, name string, b int, rate string", "g string, seed long, rate double, name string"
ARGS = {"on": ["g"], "name": "name", "batch": "b", "rate": "rate", "seed": "seed"}


def pick(spark, records, strata, cell=sample.CELL):
    r = spark.createDataFrame(records, "g string, name string, b int")
    s = spark.createDataFrame([(*x, "clash") for x in strata], "g string, seed long, rate double, other string")
    return {(x["g"], x["seed"], x["b"], x["name"]) for x in sample.frozen_bottom_k(r, s, cell=cell, **ARGS).collect()}


def brute(records, strata):
    out = set()
    for g, seed, rate in strata:
        if g is None or rate is None or rate != rate or rate <= 0:
            continue
        for b in {r[2] for r in records if r[0] == g}:
            names = [n for h, n, c in records if h == g and c == b]
            k = math.ceil(min(rate, 1) * len(names) - 1e-9)
            key = lambda n: (hashlib.md5(f"{'' if seed is None else seed}|{n}".encode()).hexdigest(), n)
            out |= {(g, seed, b, n) for n in sorted(names, key=key)[:k]}
    return out


def records(n, batches):
    rng = random.Random(1)
    return [(rng.choice(["a", "b", None]), f"p{k}", rng.randrange(batches)) for k in range(n)]


STRATA_ROWS = [("a", 1, 0.2), ("a", 2, 0.2), ("b", None, 0.35), ("a", 3, None), ("b", 4, float("nan")), ("b", 5, 7.0), ("c", 1, 0.5), (None, 1, 0.5), ("a", 9, 0.0)]


@pytest.mark.parametrize("cell", [sample.CELL, 7])
def test_exactly_the_smallest_hashes_of_each_batch(spark, cell):
    """Also where a batch is larger than what one task ranks."""
    rec = records(700, 4) + [("a", f"hot{k}", 2) for k in range(500)]
    assert pick(spark, rec, STRATA_ROWS, cell) == brute(rec, STRATA_ROWS)


def test_bounded_groups_give_the_same(spark):
    rec = records(700, 4)
    r = spark.createDataFrame(rec, "g string, name string, b int").join(sample.usable(spark.createDataFrame(STRATA_ROWS, "g string, seed long, rate double"), "rate"), "g")
    got = sample.ranked_bottom_k(r, ["g", "seed", "b"], name="name", rate="rate", seed="seed")
    assert {(x["g"], x["seed"], x["b"], x["name"]) for x in got.collect()} == brute(rec, STRATA_ROWS)


MANIFEST = [  # id, stratum, seed, eligible, sampled, as of
    (1, "a", 1, 10, 20, 1), (2, "a", 1, 10, 2, 2), (3, "a", 1, 10, 9, 3), (4, "b", None, None, 5, 1), (5, "b", None, 8, 4, 2), (6, "b", 7, 8, 0, 1), (7, "c", 1, 5, 6, 9), (8, "a", 1, 4, 1, 2),
]
NAMES = {"on": ["g"], "seed": "seed", "eligible": "e", "sampled": "s", "as_of": "b", "row_id": "i"}


def rates(spark, rows, known=None):
    m = spark.createDataFrame(rows, "i long, g string, seed long, e long, s long, b int")
    known = None if known is None else spark.createDataFrame([(*k, v) for k, v in known.items()], "g string, seed long, rate double")
    return {(r["g"], r["seed"]): r["rate"] for r in sample.freeze_rates(m, known=known, **NAMES).collect()}


def test_the_first_row_that_can_be_met_freezes_the_rate(spark):
    assert rates(spark, MANIFEST) == {("a", 1): 0.2, ("b", None): 0.5}
    held = {}
    for b in range(1, 10):
        now = rates(spark, [m for m in MANIFEST if m[5] <= b], held)
        assert held.items() <= now.items() and now == rates(spark, [m for m in MANIFEST if m[5] <= b])
        held = now
    late = [(9, "a", 1, 10, 10, 0), (10, "d", 1, 2, 1, 0)]
    assert rates(spark, MANIFEST + late, held) == {**held, ("d", 1): 0.5}


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_no_pixel_is_lost_as_batches_of_pixels_and_manifests_arrive(spark):
    rows = sorted(queries.p2_growth(spark, str(DATA)).collect())
    assert len(rows) >= 3 and rows[-1]["n_selected"] > 0
    assert all(r["n_lost"] == 0 for r in rows)
    assert all(a["n_selected"] <= b["n_selected"] and a["n_strata"] <= b["n_strata"] for a, b in zip(rows, rows[1:]))


def test_selected_records_stay_when_batches_arrive(spark):
    rec = records(600, 6)
    early = pick(spark, [r for r in rec if r[2] < 3], STRATA_ROWS)
    late = pick(spark, rec[::-1], STRATA_ROWS)
    assert early <= late and {x for x in late if x[2] < 3} == early


def test_empty(spark):
    assert pick(spark, [], STRATA_ROWS) == set()
    assert pick(spark, records(5, 1), []) == set()
