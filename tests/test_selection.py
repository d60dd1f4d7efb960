import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calorgrid.operators import selection as S

Q = {"a": 0.0, "b": 0.05, "m": 0.5, "c": 0.95, "z": 1.0}


@pytest.mark.parametrize("finish", [4096, 3])
def test_quantiles_match_numpy_with_a_hot_key(spark, finish):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.gauss(0, 1e6), rng.random(), float(rng.randrange(5))])) for _ in range(3000)]
    rows += [(f"k{rng.randrange(50)}", rng.gauss(0, 1)) for _ in range(800)] + [(None, 1.0), (None, 2.0), ("void", None), ("void", float("nan")), ("one", 7.0)]
    rows += [("same", 3.5)] * 500 + [("wide", -1.7e308), ("wide", 1.7e308), ("wide", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in S.exact_quantiles(df, ["k"], F.col("v"), Q, buckets=8, finish=finish).collect()}
    want = {}
    for k, v in rows:
        if v is not None and v == v:
            want.setdefault(k, []).append(v)
    assert set(got) == set(want)
    for k, v in want.items():
        if k != "wide":
            assert np.allclose([got[k][n] for n in Q], np.quantile(v, list(Q.values())), rtol=1e-12, atol=1e-12), k
        assert got[k]["n_values"] == len(v)
    assert got["wide"]["m"] == 0.0


def test_profile_and_hot_keys(spark):
    rows = [("a", 1)] * 60 + [("b", 1000)] * 2 + [(None, 5)] * 30 + [("c", None)] * 8
    p = S.key_profile(spark.createDataFrame(rows, "k string, v long"), "k", "v")
    got = {r["k"]: (r["n_rows"], r["total"], r["n_values"], r["median"]) for r in p.collect()}
    assert got == {"a": (60, 60, 60, 1.0), "b": (2, 2000, 2, 1000.0), None: (30, 150, 30, 5.0), "c": (8, 0, 0, None)}
    df = spark.createDataFrame(rows, "k string, v long")
    assert sorted(r["k"] for r in S.hot_keys(df, "k", "v", 0.5).collect()) == ["a", "b"]


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v double, n_values long")
    assert S.key_profile(df, "k", "v").count() == 0
    assert S.hot_keys(df, "k", "v", 0.03).count() == 0
