from datetime import datetime, timezone

from calorgrid.operators import timenorm

SCHEMA = "id long, t string, l string, z string, a string, s string, utc_micros string"
ARGS = {"row_id": "id", "text": "t", "fallback": "l", "zone": "z", "assumption": "a", "source": "s", "defaults": {"project_default_timezone": "Asia/Hong_Kong", "assumed_utc": "UTC"}}


def us(*a, micro=0, hours=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 10**6 + micro - hours * 3_600_000_000


def run(spark, rows):
    df = spark.createDataFrame([(k, *r, "clash") for k, r in enumerate(rows)], SCHEMA)
    return {r["id"]: (r["utc_micros"], r["status"]) for r in timenorm.normalise(df, **ARGS).collect()}


def test_texts_zones_and_fallbacks(spark):
    cases = [
        (("1683914073", "", "", "", "x"), us(2023, 5, 12, 17, 54, 33), "ok"),
        (("1683914073123 ", None, None, None, "x"), us(2023, 5, 12, 17, 54, 33, micro=123000), "ok"),
        (("2023-12-02T14:58:12.7794634Z", None, "Asia/Kolkata", None, "x"), us(2023, 12, 2, 14, 58, 12, micro=779463), "ok"),
        (("2023:03:14 12:14:55 +08:00", None, None, None, "x"), us(2023, 3, 14, 12, 14, 55, hours=8), "ok"),
        (("2024-12-02 04:24:49,382", None, " asia/kolkata", None, "x"), us(2024, 12, 2, 4, 24, 49, micro=382000, hours=5.5), "ok"),
        (("20240412_220027", None, "UTC+8", None, "x"), us(2024, 4, 12, 22, 0, 27, hours=8), "ok"),
        (("02-DEC-2024 04:30:09", None, "Etc/GMT-8", None, "x"), us(2024, 12, 2, 4, 30, 9, hours=8), "ok"),
        (("Dec 2, 2023 19:57:18", None, "+0530", None, "x"), us(2023, 12, 2, 19, 57, 18, hours=5.5), "ok"),
        (("12 Apr 2024, 22:15", None, None, "project_default_timezone", "x"), us(2024, 4, 12, 22, 15, hours=8), "ok"),
        (("2024-04-12 22:15:01", None, "not_available", "assumed_utc", "x"), us(2024, 4, 12, 22, 15, 1), "ok"),
        (("2024-02-30 10:15:00", "2024-02-28T10:15:00+08:00", None, None, "x"), us(2024, 2, 28, 10, 15, hours=8), "ok"),
        (("12 Apr 2024, 22:15", "2024-04-12T22:15:44+08:00", None, None, "x"), us(2024, 4, 12, 22, 15, hours=8), "ok"),
        (("2024-03-31 02:29:20", None, "Europe/Berlin", None, "x"), None, "nonexistent_time"),
        (("2024-10-27 02:29:20", None, "Europe/Berlin", None, "x"), None, "ambiguous_time"),
        (("2024-10-27 02:29:20", "2024-10-27T02:29:20+01:00", "Europe/Berlin", None, "x"), us(2024, 10, 27, 1, 29, 20), "ok"),
        (("2024-10-27 02:29:20", "2024-10-27T02:29:21+01:00", "Europe/Berlin", None, "x"), None, "ambiguous_time"),
        (("2024-04-12 22:15:01", None, "nowhere", None, "x"), None, "no_zone"),
        (("2024-04-12 22:15:01", None, None, "unknown", "x"), None, "no_zone"),
        ((None, None, None, None, None), None, "invalid"),
        (("", " ", "UTC", None, "x"), None, "invalid"),
        (("0000:00:00 00:00:00", "--", "UTC", None, "x"), None, "invalid"),
        (("25:61", "x" * 50_000, "UTC", None, "x"), None, "invalid"),
    ]
    got = run(spark, [c[0] for c in cases])
    for k, (row, want, status) in enumerate(cases):
        assert got[k] == (None if want is None else int(want), status), (row, got[k])


def test_mixture_keeps_one_order_per_source(spark):
    dmy = [("13/04/2024 10:00:00", None, "UTC", None, "d"), ("04/05/2024 10:00:00", None, "UTC", None, "d")]
    mdy = [("4/13/2024 1:00:00 PM", None, "UTC", None, "m"), ("4/5/2024 12:30:00 AM", None, "UTC", None, "m")]
    unknown = [("04/05/2024 10:00:00", None, "UTC", None, "u"), ("06/06/2024 10:00:00", None, "UTC", None, None)]
    shown = [("04/05/2024 10:00:00", "2024-05-04T10:00:00", "UTC", None, "w")] * 40
    got = run(spark, dmy + mdy + unknown + shown)
    assert got[1] == (us(2024, 5, 4, 10), "ok") and got[3] == (us(2024, 4, 5, 0, 30), "ok")
    assert got[4][1] == "ambiguous_format" and got[5][1] == "ambiguous_format"
    assert got[6] == (us(2024, 5, 4, 10), "ok")


def test_empty(spark):
    assert run(spark, []) == {}
