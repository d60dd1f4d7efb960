import math
import zlib

import pytest
from pyspark.sql import functions as F

from calorgrid.functions import geo, hashing, predicates as P, text as T
from calorgrid.operators import ranks


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_predicates(spark):
    lit = F.lit
    nan = lit(float("nan"))
    assert list(one(spark, P.finite(nan), P.finite(lit(None).cast("float")), P.finite(lit(1.0)), P.delta_t(lit(3.0), nan), P.truthy(lit(" YES ")), P.truthy(lit(None).cast("string")))) == [False, False, True, None, True, False]
    assert list(one(spark, P.open_space(lit("31"), lit(None).cast("string")), P.open_space(lit("residential"), lit("x")), P.open_space(lit(None).cast("string"), lit("GIC / Open Space")))) == [True, False, True]
    assert list(one(spark, *[P.shadow_flag(lit(x)) for x in ("", "Shaded", "2", "unclear")])) == [0, 1, 2, None]
    assert list(one(spark, *[P.missing_metadata(lit(x)) for x in ("Unknown", " n/a ", "ok", None)])) == [True, True, False, True]
    assert one(spark, P.camera_class(lit("visible"), lit(6.9), lit(24.5), [("wide", 6.7, 24.0)]))[0] == ("wide", "high")
    assert one(spark, P.camera_class(lit("thermal"), lit(12.1), lit(52.4), []))[0] == ("thermal", "high")
    assert list(one(spark, *[P.segment_class(*[lit(float(v)) for v in c]) for c in ((0, 0, 0, 0, 0, 0.1, 0), (0.2, 0.5, 0.2, 0.3, 0.5, 0.4, 0), (0.2, 0.2, 0.5, 0.55, 0.5, 0.6, 0), (0.5, 0.5, 0.5, 0, 0.05, 0.7, 0), (0.3, 0.3, 0.3, 0, 0.1, 0.3, 0))])) == ["unclear_ignore", "vegetation_tree", "water", "concrete_pavement", "asphalt_road"]
    assert one(spark, P.ladder_notes((lit(True), "a"), (lit(None).cast("boolean"), "b"), (lit(True), "c")))[0] == "a; c"


def test_text(spark):
    lit = F.lit
    assert list(one(spark, T.number_in_text(lit("about 1,234.5 m")), T.number_in_text(lit("3,5"), "decimal"), T.number_in_text(lit("12 m below sea")), T.number_in_text(lit("−7")), T.number_in_text(lit("none")))) == [1234.5, 3.5, -12.0, -7.0, None]
    assert [round(x, 6) for x in one(spark, T.coordinate(lit("22 deg 18' 30\" N"), lit(None).cast("string")), T.coordinate(lit("22.5"), lit("South")), T.coordinate(lit("114.1 W"), lit("")))] == [22.308333, -22.5, -114.1]
    n = T.capture_name(lit("a/b/dji_20240102030405_0012_t.JPG"))
    assert list(one(spark, n["image"], n["sample"], n["role"])) == ["DJI_20240102030405_0012", 12, "T"]
    assert list(one(spark, T.slug(lit(" A b/ç ")), T.plain_tag(lit("EXIF:GPS-Latitude")), T.normal_path(lit("A\\B/c")))) == ["a_b", "gpslatitude", "a/b/c"]
    assert T.number_list("3-5, 1,4", 9) == [1, 3, 4, 5]
    with pytest.raises(ValueError):
        T.number_list("0", 9)


def text_lines(spark, *texts):
    return T.lines(spark.createDataFrame(list(enumerate(texts, 1)), "id long, t string"), "id", "t")


def test_measurements(spark):
    text = """Point P1: x=12, y=34; temperature=25.5 C
        on the wall: point P2 (north) temp = -1 °C and more text
        Region R.1: geometry=polygon[(1,2),(3,4)]; min=21 max=30 mean=25 C
        Region R2, a roof; ellipse = 3 4 5; then min = 1.5; max = 2 with mean = 1.75
        Point P3: temperature=72 F
        Point P4 value=300 kelvin
        Point P1 value=3
        Region R3: min=1 max=2
        no point in this line"""
    m = {(r["measurement_id"], r["value"]): (r["kind"], r["x"], r["y"], r["region_type"], r["geometry"], r["status"]) for r in T.measurements(text_lines(spark, text, None), "id").collect()}
    assert m == {
        ("P1", 25.5): ("point", 12.0, 34.0, "", "", "duplicate"), ("P1", 3.0): ("point", None, None, "", "", "duplicate"), ("P2", -1.0): ("point", None, None, "", "", "ok"),
        ("P3", 72.0): ("point", None, None, "", "", "not_celsius"), ("P4", 300.0): ("point", None, None, "", "", "not_celsius"),
        **{(f"R.1:{s}", v): ("region", None, None, "polygon", "polygon[(1,2),(3,4)]", "ok") for s, v in (("min", 21.0), ("max", 30.0), ("mean", 25.0))},
        **{(f"R2:{s}", v): ("region", None, None, "region", "3 4 5; then min = 1.5", "ok") for s, v in (("min", 1.5), ("max", 2.0), ("mean", 1.75))},
    }
    assert T.valid_measurements(text_lines(spark, "Point A: value=1"), "id").count() == 1
    for bad in ("Point A: value=1 F", "Point A: value=1\nPoint A: value=2"):
        with pytest.raises(Exception, match="not_celsius|duplicate"):
            T.valid_measurements(text_lines(spark, bad), "id").collect()


def test_values_after_labels(spark):
    fields = {"e": ("发射率", "Emissivity"), "t": ("Ambient Temperature", "Ambient Temp"), "d": ("Distance",)}
    lines = text_lines(spark, "EMISSIVITY：\n0.95\nAmbient Temp: 20 C\nAmbient Temperature: 21 C\nDistance", "发射率： 0,9\n距离\n5", None)
    v = {(r["id"], r["field"]): r["value"] for r in T.value_after_label(lines, "id", fields).collect()}
    assert v == {(1, "e"): "0.95", (1, "t"): "20 C", (1, "d"): None, (2, "e"): "0,9"}


def test_report_records(spark):
    first = "Report\nimage DJI_20240102030405_0012_T.JPG\nDJI_20240102030405_0012_T.jpg\n环境温度\n-3,5 °C\n反射温度：20\n空气湿度 60%\nEmissivity\n0.95\nObject Distance: 5.5 m\n2024/01/02 03:04:05\nGPS: 22.5, 114,25\n设备型号：M3T\nWidth: 640\nSerial Number\nX1"
    text = first + "\nDJI_20240102030406_0013_T.JPEG\nDJI_20240102030405_0012_T.JPG\nHeight 512 px"
    assert [r["entry"] for r in T.report_entries(text_lines(spark, text), "id").orderBy("line_no").collect()] == [0] + [1] * 15 + [2] + [3] * 2
    one, two, three = [r.asDict() for r in T.report_records(text_lines(spark, text), "id").orderBy("report_entry_index").collect()]
    assert len(one) == 23
    want = {
        "image_name": "DJI_20240102030405_0012_T.JPG", "image_id": "DJI_20240102030405_0012", "ambient_parse_status": "ok", "ambient_temperature_c": -3.5, "reflected_temperature_c": 20.0, "humidity_percent": 60.0, "emissivity": 0.95,
        "distance_m": 5.5, "report_capture_datetime": "2024-01-02 03:04:05", "gps_latitude_report": 22.5, "gps_longitude_report": 114.25, "camera_model_report": "M3T", "serial_number_report": "X1", "image_width_report": 640, "image_height_report": None, "aperture_report": "",
    }
    assert {k: one[k] for k in want} == want and one["raw_parameter_text"] == "\n".join(first.split("\n")[1:])
    assert (two["image_id"], two["ambient_parse_status"], two["raw_parameter_text"]) == ("DJI_20240102030406_0013", "missing", "DJI_20240102030406_0013_T.JPEG")
    assert three["image_height_report"] == 512


def test_geometry(spark):
    lit = F.lit
    assert one(spark, geo.haversine_m(lit(0.0), lit(179.9999), lit(0.0), lit(-179.9999)))[0] == pytest.approx(math.radians(2e-4) * geo.EARTH_M)
    xs, ys = F.array(*map(lit, (0.0, 4.0, 4.0, 0.0))), F.array(*map(lit, (0.0, 0.0, 3.0, 3.0)))
    assert list(one(spark, geo.shoelace(xs, ys), geo.valid_polygon(xs, ys), geo.valid_polygon(F.slice(xs, 1, 2), F.slice(ys, 1, 2)))) == [12.0, True, False]
    tri = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]
    assert list(one(spark, geo.inside_polygon(lit(1.0), lit(1.0), tri), geo.inside_polygon(lit(3.0), lit(3.0), tri))) == [True, False]
    assert one(spark, geo.field_of_view(lit(18.0), lit(36.0)))[0] == pytest.approx(90.0)


def python_mix(x, seed):
    m = (1 << 64) - 1
    z = (x + seed + hashing.GOLDEN) & m
    z = ((z ^ z >> 30) * hashing.MIX_A) & m
    z = ((z ^ z >> 27) * hashing.MIX_B) & m
    return z ^ z >> 31


def test_hashes(spark):
    for seed in (0, 42, 2**63 + 11):
        df = hashing.with_splitmix64(spark.range(300).selectExpr("id * 92233720368547 as x"), "x", F.lit(hashing.gamma(seed)), "z")
        for r in df.collect():
            assert r["z"] % (1 << 64) == python_mix(r["x"] % (1 << 64), seed)
    words = [-1, 0, 1, 2**63 - 1, -(2**63)]
    got = [r["w"] for r in spark.createDataFrame([(w,) for w in words], "w long").orderBy(hashing.unsigned_order(F.col("w"))).collect()]
    assert got == sorted(words, key=lambda w: w % (1 << 64))
    assert one(spark, F.crc32(F.lit("roof").cast("binary")))[0] == zlib.crc32(b"roof")


def test_tails():
    assert ranks.upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-12)
    assert ranks.upper_gamma(5, 18.307038053275146 / 2) == pytest.approx(0.05, abs=1e-12)
    assert ranks.upper_gamma(1, 0) == 1.0


def test_hong_kong_grid(spark):
    # the published rule of thumb: HK80 latitude is WGS 84 plus 5.5 seconds, longitude minus 8.8 seconds
    lat0, lon0, east0, north0 = geo.HK80_GRID
    g = one(spark, geo.hong_kong_grid(F.lit(lat0 - 5.5 / 3600), F.lit(lon0 + 8.8 / 3600)))[0]
    assert abs(g["easting"] - east0) < 5 and abs(g["northing"] - north0) < 5
    a, b = one(spark, geo.hong_kong_grid(F.lit(22.40), F.lit(114.10)), geo.hong_kong_grid(F.lit(22.41), F.lit(114.11)))
    flat = math.hypot(b["easting"] - a["easting"], b["northing"] - a["northing"])
    assert flat == pytest.approx(one(spark, geo.haversine_m(F.lit(22.40), F.lit(114.10), F.lit(22.41), F.lit(114.11)))[0], rel=5e-3)
