import json

from calorgrid.operators import drift

SCHEMA = "rid long, feed string, fid long, seq int, payload string, field string"
ARGS = {"payload": "payload", "feed": "feed", "file_id": "fid", "seq": "seq", "key": "uid"}


def frame(spark, files):
    rows = []
    for feed, fid, seq, lines in files:
        for x in lines:
            rows.append((len(rows), feed, fid, seq, x if x is None or isinstance(x, str) else json.dumps(x), "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return sorted((r["file_id"], r["field_before"], r["field_after"], r["change_kind"]) for r in drift.changes(frame(spark, files), **ARGS).collect())


FIRST = [{"uid": f"p{k}", "t": k + 0.5, "kind": "a", "flag": True, "old": str(k)} for k in range(10)]


def test_every_kind_of_change(spark):
    second = [{"uid": f"p{k}", "temp": str(k + 0.5), "kind": ["a"], "new": None if k else 1, "old": k} for k in range(10)]
    files = [("f", 1, 1, [*FIRST, FIRST[0], '{"uid":"p1","broken', "[1]", "7", None, ""]), ("f", 2, 3, second)]
    assert changes(spark, files) == [(2, "", "new", "added"), (2, "flag", "", "removed"), (2, "kind", "kind", "retyped"), (2, "old", "old", "retyped"), (2, "t", "temp", "renamed"), (2, "t", "temp", "retyped")]


def test_different_values_are_no_renaming(spark):
    second = [{"uid": f"p{k}", "temp": k + 0.5 + (k == 3), "kind": "a", "flag": True, "old": str(k)} for k in range(10)]
    assert changes(spark, [("f", 1, 1, FIRST), ("f", 2, 2, second)]) == [(2, "", "temp", "added"), (2, "t", "", "removed")]


def test_fields_that_come_back_and_files_of_broken_lines(spark):
    one, two = [{"uid": "a", "x": 1}], [{"uid": "a"}]
    assert changes(spark, [("f", 1, 1, one), ("f", 2, 2, two), ("f", 3, 3, one)]) == [(2, "x", "", "removed"), (3, "", "x", "added")]
    got = changes(spark, [("f", 1, 1, one), ("f", 2, 2, ["{"]), ("g", 3, 1, one), (None, 4, 1, one), (None, 5, 2, two)])
    assert got == [(2, "uid", "", "removed"), (2, "x", "", "removed"), (5, "x", "", "removed")]


def test_majority_type_and_nulls_only(spark):
    a = [{"uid": "a", "x": 1, "y": None}, {"uid": "b", "x": 2}, {"uid": "c", "x": "stray"}]
    b = [{"uid": "a", "x": 1, "y": "now"}, {"uid": "b", "x": "s"}, {"uid": "c", "x": "t"}]
    assert changes(spark, [("f", 1, 1, a), ("f", 2, 2, b)]) == [(2, "x", "x", "retyped")]


def test_empty(spark):
    assert changes(spark, []) == []


def test_consistent_table(spark):
    second = [{"uid": f"p{k}", "temp": {"value": k + 0.5, "unit": "C"}, "kind": ["a"], "flag": "true", "old": k} for k in range(10)]
    mid = [{"uid": f"p{k}", "temp": str(k + 0.5), "kind": "a", "flag": True, "old": str(k), "feed": 3} for k in range(10)]
    files = [("f", 1, 1, FIRST), ("f", 2, 2, mid), ("f", 3, 3, [*second, "{"])]
    out = drift.consistent_table(frame(spark, files), keep=["rid", "feed"], **ARGS)
    rows = out.collect()
    assert len(rows) == 30 and out.columns[:2] == ["rid", "feed"] and "feed_field" in out.columns
    name = "temp" if "temp" in out.columns else "t"
    assert [r[name] for r in rows if r["uid"] == "p4"] == [4.5] * 3
    assert {r["kind"] for r in rows} == {"a"} and {r["flag"] for r in rows} == {True}


def test_fields_beyond_the_columns_come_in_a_map(spark):
    lines = [{"uid": f"p{k}", "a": k, **{f"x{k}": str(k)}} for k in range(5)]
    out = drift.consistent_table(frame(spark, [("f", 1, 1, lines)]), keep=["rid"], most=2, **ARGS)
    assert sorted(out.columns) == ["a", "more_fields", "rid", "uid"]
    assert {r["uid"]: r["more_fields"] for r in out.collect()} == {f"p{k}": {f"x{k}": str(k)} for k in range(5)}


def test_lifespans_by_type(spark):
    one, text, none = [{"uid": "a", "x": 1}], [{"uid": "a", "x": "1"}], [{"uid": "a"}]
    files = [("f", k, k, x) for k, x in enumerate([one, one, text, none, one])]
    spans = drift.history(frame(spark, files), **ARGS)[1].where("field = 'x'").collect()
    got = sorted((r["first_file"], r["last_file"], r["ftype"], r["island"], r["n_files"], r["begins"], r["type_before"], r["ends"]) for r in spans)
    assert got == [(0, 1, "number", 1, 2, False, None, False), (2, 2, "string", 1, 1, False, "number", True), (4, 4, "number", 2, 1, True, None, False)]
