"""Queries over all rows they are given, on small tables made here."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]
import __spark_entry__ as entry  # noqa: E402


def float32(x):
    return float(np.float32(x))


def result(spark, folder, name, **tables):
    """Rows of the query over the given tables (rows and schema each)."""
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return entry.queries()[name](spark, str(folder)).collect()


def test_recurrence_has_no_cap(spark, tmp_path):
    """One coordinate is warm in all 15 images, one in 3."""
    pixels = [(f"i{k:02}", 5, 7, 31.0) for k in range(15)] + [(f"i{k:02}", 6, 7, 31.0) for k in range(3)]
    got = result(spark, tmp_path, "agg15_recurring_coordinates", pixel_samples=(pixels, "image_id string, thermal_row short, thermal_col short, temperature_c float"))
    assert {r["images"]: r["n_coordinates"] for r in got} == {k: int(k in (3, 15)) for k in range(2, 16)}


def test_ordered_sample_keeps_every_row(spark, tmp_path):
    pixels = [("a", r, 1.5) for r in range(40)]
    got = result(spark, tmp_path, "snk06_ordered_sample", pixel_samples=(pixels, "image_id string, thermal_row short, temperature_c float"))
    assert sorted(map(tuple, got)) == [("a", None, r) for r in range(40)]
    assert got[0].__fields__ == ["image_id", "roi_id", "thermal_row"]


def test_pairing_sees_every_file(spark, tmp_path):
    """Records 7, 11 and 77 have both files, 1 lacks the visible and 2 the thermal one."""
    path = lambda k, side: f"raw/f/DJI_20240101000000_{k:04}_{side}.JPG"
    records = [(k, "f", None if k == 1 else path(k, "V"), "" if k == 2 else path(k, "T")) for k in (1, 2, 7, 11, 77)]
    got = result(spark, tmp_path, "join07_pair_two_stage", validation_records=(records, "record_id long, flight_id string, visible_path string, thermal_path string"))
    paired = [("base", "f", f"DJI_20240101000000_{k:04}", path(k, "V"), path(k, "T"), "ok") for k in (7, 11, 77)]
    assert sorted(map(tuple, got), key=lambda r: r[:3]) == [*paired, ("sample", "f", "1", None, path(1, "T"), "missing_visible"), ("sample", "f", "2", path(2, "V"), None, "missing_thermal")]


def test_fallback_sees_every_row_of_a_capture(spark, tmp_path):
    """The smallest name of capture a and the second class of flight f lie below row 40."""
    pixels = [("f", "a", 3, "wood"), ("f", "a", 400, "road"), ("g", "b", 500, "wood")]
    asked = [(1, "f", "a"), (2, "f", "x"), (3, "g", "x"), (4, "h", "x")]
    got = result(
        spark, tmp_path, "join22_unique_fallback",
        pixel_samples=(pixels, "flight_id string, image_id string, thermal_row short, luhk_class_name string"),
        subzero_qa=(asked, "qa_id long, flight_id string, image_id string"),
    )
    assert sorted(map(tuple, got)) == [(1, "road", "exact"), (2, None, "ambiguous"), (3, "wood", "unique"), (4, None, "missing")]


def test_intersection_of_every_series(spark, tmp_path):
    """Flight f has three captures and (1, 1) in all of them, g two of which one is not finite at (1, 1), h none that is finite."""
    nan = float("nan")
    pixels = [("f", i, 1, c, 20.0) for i in "abc" for c in (1, 2) if (i, c) != ("c", 2)]
    pixels += [("g", "d", 1, 1, 20.0), ("g", "e", 1, 1, nan), ("g", "d", 3, 3, 20.0), ("g", "e", 3, 3, 20.0), ("h", "k", 1, 1, 20.0), ("h", "l", 1, 1, None)]
    got = result(spark, tmp_path, "set04_intersect", pixel_samples=(pixels, "flight_id string, image_id string, thermal_row short, thermal_col short, temperature_c float"))
    assert sorted(map(tuple, got)) == [("f", 1, 1), ("g", 3, 3)]


PIXELS = """image_id string, thermal_row short, thermal_col short, delta_t_c float, luhk_class_code int, luhk_class_name string, luhk_label_valid boolean,
    surface_cover_class string, surface_cover_valid boolean, shadow_flag byte, shadow_valid boolean, analysis_eligible boolean, target_mask boolean"""


def pixel(image, row, col, d, code, cover, valid=True):
    return (image, row, col, d, code, f"class {code}", code is not None, cover, True, 0, True, valid, True)


def test_summary_describes_the_drawn_sample(spark, tmp_path):
    """One pixel of every tile of 8 x 8 is drawn, of formal pixels with a land-use label only."""
    pixels = [pixel("a", r, 1, d, 1, "road") for r, d in ((1, 1.0), (9, 2.0), (17, 9.0), (25, 4.0), (26, 4.0))]
    pixels += [pixel("a", 33, 1, 7.0, None, "road"), pixel("b", 1, 1, 5.0, 2, "road", valid=False)]
    got = result(spark, tmp_path, "agg03_full_and_sample", pixel_samples=(pixels, PIXELS))
    assert {tuple(r) for r in got} == {(1, 5, 1, 4.0, 4, 4.0, 3.0), (None, 1, 1, 7.0, 0, None, None), (2, 1, 1, 5.0, 0, None, None)}


def test_manifest_counts_the_drawn_sample(spark, tmp_path):
    pixels = [pixel("a", r, 1, 1.0, 1, "road") for r in (1, 2, 9)] + [pixel("a", 64, 1, 1.0, 1, "wood", valid=False)]
    got = result(spark, tmp_path, "join12_manifest_counts", pixel_samples=(pixels, PIXELS))
    assert sorted(map(tuple, got)) == [("a", "road", 3, 2), ("a", "wood", 1, 0)]


def test_shadow_contrast_is_tested_within_each_cover(spark, tmp_path):
    """Road has enough pixels in two images, wood no shade, grass too few, soil a third flag."""
    rows = []

    def add(cover, flag, values):
        for k, v in enumerate(values):  # a tile each
            rows.append((f"i{k % 2}", 8 * (len(rows) % 60), 8 * (len(rows) // 60), v, None, None, None, cover, True, flag, True, True, True))

    sunlit, shaded = [k / 7 for k in range(120)], [1 + k / 5 for k in range(110)]
    add("road", 0, sunlit), add("road", 1, shaded), add("wood", 0, [9.0] * 3), add("grass", 0, [1.0] * 3), add("grass", 1, [2.0] * 2)
    add("soil", 0, [1.0]), add("soil", 1, [1.0]), add("soil", 2, [1.0])
    got = {r["cover"]: r for r in result(spark, tmp_path, "st03_shadow_tests", pixel_samples=(rows, PIXELS))}
    u = sum((round(x, 6) > round(y, 6)) + 0.5 * (round(x, 6) == round(y, 6)) for x in map(float32, sunlit) for y in map(float32, shaded))
    road = got["road"]
    assert (road["n_sunlit"], road["n_shaded"], road["images_sunlit"], road["u"], road["status"]) == (120, 110, 2, u, "exploratory_only_spatial_dependence_remains")
    assert road["effect"] == pytest.approx(2 * u / (120 * 110) - 1) and 0 < road["p_value"] < 1e-3
    assert {c: r["status"] for c, r in got.items() if c != "road"} == dict.fromkeys(("wood", "grass", "soil"), "skipped")
    assert "fails minimum" in got["grass"]["reason"] and all("not present" in got[c]["reason"] and got[c]["u"] is None for c in ("wood", "soil"))


def test_tests_of_groups_skip_those_of_few_pixels_or_images(spark):
    from calorgrid.operators import ranks

    rows = [("f", "a", f"i{k % 3}", float(k)) for k in range(150)] + [("f", "b", f"i{k % 2}", k / 2) for k in range(130)] + [("f", "c", "i1", 1.0)] * 200 + [("f", "d", "i1", 1.0)] * 3 + [("g", "a", "i1", 2.0)] * 5
    overall, pairs = ranks.group_tests(spark.createDataFrame(rows, "fam string, grp string, img string, v double"), scope="fam", group="grp", unit="img", value="v")
    got = {r["scope"]: (r["n_groups"], r["status"]) for r in overall.collect()}
    assert got == {"f": (2, "exploratory_only_spatial_dependence_remains"), "g": (None, "skipped")}
    status = {(r["group_a"], r["group_b"]): (r["reason"][:35], r["u"] is None) for r in pairs.collect()}
    few, once = ("At least one group has fewer than 1", True), ("At least one group occurs in fewer ", True)
    assert status == {("a", "b"): ("", False), ("a", "c"): once, ("a", "d"): few, ("b", "c"): once, ("b", "d"): few, ("c", "d"): few}
