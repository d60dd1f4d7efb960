import random

import pytest

from calorgrid.llm import packing


def check(spark, counts, capacity, band_rows=packing.BAND_ROWS):
    """Loads of the containers after filling them with items of the counted sizes."""
    classes = spark.createDataFrame([(1, s, n) for s, n in counts.items()], "spec int, size long, n long")
    load, seen = {}, set()
    for m in packing.best_fit(classes, {1: capacity}, band_rows).collect():
        for i in range(m["n"]):
            at = m["container"] + i // m["per"]
            load[at] = load.get(at, 0) + m["size"]
            assert (m["size"], m["first"] + i) not in seen
            seen.add((m["size"], m["first"] + i))
    assert all(x <= capacity for x in load.values())
    assert seen == {(s, k) for s, n in counts.items() for k in range(n)}
    assert set(load) == set(range(len(load)))
    return len(load)


@pytest.mark.parametrize("seed, band_rows", [(0, packing.BAND_ROWS), (1, 20), (2, packing.BAND_ROWS), (3, 40)])
def test_every_item_once_within_capacity_and_little_waste(spark, seed, band_rows):
    """Also where the runs are cut into many bands."""
    rng = random.Random(seed)
    capacity = rng.choice([128, 1000])
    counts = {}
    for _ in range(4000):
        s = min(capacity, int(rng.expovariate(1 / (capacity / 6))) + 1)
        counts[s] = counts.get(s, 0) + 1
    used = check(spark, counts, capacity, band_rows)
    whole = sum(s * n for s, n in counts.items())
    assert used <= whole / capacity * 1.03 + 2


def test_edges(spark):
    assert check(spark, {}, 10) == 0
    assert check(spark, {10: 3}, 10) == 3
    assert check(spark, {6: 4}, 10) == 4
    assert check(spark, {1: 25}, 10) == 3
    assert check(spark, {2**30: 3, 5: 2}, 2**31) == 2


def test_a_sweep_takes_the_smallest_gap_that_holds_an_item():
    rows = [(packing.GAP, 9, 0, 1), (packing.GAP, 5, 7, 2), (packing.ITEM, 4, 0, 3), (packing.ITEM, 2, 0, 1)]
    got = packing.sweep(rows, 1)
    assert [r[2:] for r in got if r[0] == packing.MOVE] == [(4, 0, 2, 7, 1), (4, 2, 1, 0, 1)]
    assert sorted(r[2:5] for r in got if r[0] != packing.MOVE) == [(1, 7, 2), (2, 0, 1), (5, 0, 1)]


def rows(spark, sizes, specs):
    df = spark.createDataFrame([(*x, 7) for x in sizes], "doc_id long, n long, container_id int")
    return packing.fill_containers(df, specs).collect()


def test_frame(spark):
    rng = random.Random(3)
    sizes = [(k, rng.choice([0, None, 5, 5, 5, rng.randrange(1, 300), 128, 256, 1000])) for k in range(600)] + [(5, 40), (5, 40)]
    out = rows(spark, sizes, {1: 128, 2: 512})
    for spec, cap in ((1, 128), (2, 512)):
        mine = [r for r in out if r["spec_id"] == spec]
        load, docs = {}, {}
        for r in mine:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
            docs.setdefault(r["doc_id"], []).append((r["part_no"], r["token_from"], r["n_tokens"]))
        assert max(load.values()) <= cap and set(load) == set(range(len(load)))
        assert len(load) <= sum(load.values()) / cap * 1.05 + 1
        for k, n in sizes[:600]:
            if k == 5:
                continue
            n = n or 0
            want = [(p, p * cap, min(cap, n - p * cap)) for p in range(max(1, -(-n // cap)))]
            assert sorted(docs[k]) == want
    assert out and sorted(map(tuple, out)) == sorted(map(tuple, rows(spark, sizes[::-1], {1: 128, 2: 512})))


def test_null_and_large_ids(spark):
    big = 2**62 + 1
    out = rows(spark, [(None, 5), (big, 6), (big + 2, 7)], {1: 10})
    assert {r["doc_id"] for r in out} == {None, big, big + 2} and len({r["container_id"] for r in out}) == 3


def test_empty(spark):
    assert rows(spark, [], {1: 10}) == []
