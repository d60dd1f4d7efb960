import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from calorgrid.sources import files, grids, tables
from calorgrid.streaming.arrivals import arrival_counts


def test_matrices(spark, tmp_path):
    a = np.arange(12, dtype="float32").reshape(3, 4)
    np.save(tmp_path / "one.npy", a)
    a.astype("<f4").tofile(tmp_path / "two.raw")
    rows = grids.read_npy(spark, str(tmp_path)).collect()
    assert {(r["image_id"], r["thermal_row"], r["thermal_col"], r["value"]) for r in rows} == {("one", r, c, float(a[r, c])) for r in range(3) for c in range(4)}
    assert grids.read_raw(spark, str(tmp_path), 4, 3).count() == 12
    assert grids.read_masks(spark, str(tmp_path), (3, 4)).count() == 12
    for bad in (lambda: grids.read_raw(spark, str(tmp_path), 4, 4), lambda: grids.read_masks(spark, str(tmp_path), (4, 3))):
        with pytest.raises(Exception, match="instead of"):
            bad().collect()


def test_listing_and_reports(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "DJI_20240102030405_0012_T.JPG").write_bytes(b"x")
    (tmp_path / "s" / "note.txt").write_text("a\r\nb\n")
    with zipfile.ZipFile(tmp_path / "r.docx", "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Ambient</w:t></w:r><w:r><w:t>: 20</w:t></w:r></w:p><w:p/></w:body></w:document>")
    f = files.list_files(spark, str(tmp_path)).collect()
    assert [(r["image"], r["sample"], r["role"]) for r in f] == [("DJI_20240102030405_0012", 12, "T")]
    assert [r["line"] for r in files.read_docx(spark, str(tmp_path)).orderBy("line_no").collect()] == ["Ambient: 20"]
    assert [r["line"] for r in files.read_lines(spark, str(tmp_path / "s" / "note.txt")).orderBy("line_no").collect()] == ["a", "b", ""]
    assert files.file_digests(spark, str(tmp_path), "*.txt").count() == 1


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"image_id": "a", "schema_version": "9"}))
    m = files.read_manifests(spark, str(tmp_path / "m.json"), "image_id string, schema_version string, route string", ["image_id", "route"]).first()
    assert m["violations"] == "missing route;unsupported version"
    (tmp_path / "run.json").write_text(json.dumps({"groups": [{"image_id": "a", "status": "success", "manifest_path": "p"}, {"image_id": "b", "status": "failed", "manifest_path": "q"}]}))
    assert [tuple(r) for r in files.included(spark, str(tmp_path / "run.json")).collect()] == [("a", "p")]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.5), ("b", 2, float("nan")), ("b", 3, None)], "image_id string, pixel_y int, v double")
    path = str(tmp_path / "c")
    tables.write_canonical(df, path)
    got = tables.read_canonical(spark, path, {"image_id": "", "pixel_y": 0, "absent": "d"})
    assert sorted(map(tuple, got.collect())) == [("a", 1, "d"), ("b", 2, "d"), ("b", 3, "d")]
    assert "PartitionFilters: [isnotnull(image_id" in got.where("image_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert tables.with_defaults(df, {"thermal_row": -1}, {"thermal_row": ["pixel_y"]}).first()[0] in (1, 2, 3)
    with pytest.raises(tables.ContractError):
        tables.with_defaults(df, {"nope": 0}, required=["nope"])
    with pytest.raises(tables.ContractError):
        tables.one_row_each(df, "image_id")
    with pytest.raises(tables.ContractError):
        tables.one_row_each(df.limit(1), "image_id", df)
    with pytest.raises(tables.ContractError):
        tables.read_sample(spark, path, ["v"], "pixel_y", "v")
    assert [json.loads(r["json"]) for r in tables.strict_json(df).collect()][1] == {"image_id": "b", "pixel_y": 2, "v": None}
    assert tables.ordered(df, ["v", "x"]).columns == ["v", "x"]
    csv = str(tmp_path / "csv")
    tables.write_csv(df.select("image_id", F.lit("").alias("e")), csv)
    assert {r["e"] for r in tables.read_text_table(spark, csv).collect()} == {""}
    box = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, "n")], "w double, s double, e double, n double, name string")
    g = json.loads(tables.geojson_features(box, "w", "s", "e", "n", ["name"]).first()[0])
    assert g["geometry"]["coordinates"][0][0] == g["geometry"]["coordinates"][0][-1] == [1.0, 2.0] and g["properties"] == {"name": "n"}


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "a"), (4000, "b")], "s long, k string").selectExpr("timestamp_seconds(s) as at", "k").write.parquet(src)
    stream = spark.readStream.schema("at timestamp, k string").parquet(src)
    q = arrival_counts(stream, "at", "k").writeStream.outputMode("complete").format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["k"], r["n"]) for r in spark.table("arrivals").collect()) == [("a", 2), ("b", 1)]
    assert io is not None
