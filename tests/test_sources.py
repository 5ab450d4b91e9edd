import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import raster
from terrafold.operators import extraction
from terrafold.sources import files, sinks


def geotiff(epsg=32644, scale=0.5):
    """A little-endian TIFF header with georeferencing."""
    keys = struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, epsg)
    entries = [(256, 4, 1, 30), (257, 4, 1, 20), (258, 3, 1, 16), (277, 3, 1, 3), (339, 3, 1, 1)]
    extra = [(33550, 12, 3, struct.pack("<3d", scale, scale, 0)), (33922, 12, 6, struct.pack("<6d", 0, 0, 0, 100, 900, 0)), (34735, 3, 8, keys), (42113, 2, 5, b"-999\0")]
    start = 8 + 2 + 12 * (len(entries) + len(extra)) + 4
    head, body = b"", b""
    for tag, kind, n, value in entries:
        head += struct.pack("<HHII", tag, kind, n, value)
    for tag, kind, n, data in extra:
        head += struct.pack("<HHII", tag, kind, n, start + len(body))
        body += data
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries) + len(extra)) + head + b"\0\0\0\0" + body


def test_geotiff_headers(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(geotiff())
    (tmp_path / "b.tif").write_bytes(geotiff(epsg=32767))
    (tmp_path / "c.tif").write_bytes(b"no tiff")
    got = {r["source_id"]: r for r in files.inspect_rasters(files.binary_files(spark, str(tmp_path), "*.tif")).collect()}
    a = got["a.tif"]
    assert (a["width"], a["height"], a["bands"], a["dtype"], a["epsg"], a["nodata"], a["error"]) == (30, 20, 3, "uint16", 32644, -999.0, None)
    assert tuple(a["bounds"]) == (100.0, 890.0, 115.0, 900.0) and a["estimated_bytes"] == 30 * 20 * 3 * 2
    assert got["b.tif"]["error"] == "CRS_MISSING" and got["c.tif"]["error"] == "NOT_A_GEOTIFF"


def test_geojson_shapes(spark):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    geometry = {"type": "Polygon", "coordinates": square}
    texts = [geometry, {"type": "Feature", "geometry": geometry}, {"type": "FeatureCollection", "features": [{"geometry": geometry}]}, square, {"type": "FeatureCollection", "features": [{"geometry": geometry}] * 2}, {"type": "Point", "coordinates": [1, 2]}]
    df = spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(texts)], "k int, v string").orderBy("k")
    assert [r[0] and len(r[0]) for r in df.select(files.geojson_ring(F.col("v"))).collect()] == [4, 4, 4, 4, None, None]


def test_pages_tokens_and_failures(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"one|two")
    (tmp_path / "bad.txt").write_bytes(b"!")

    def render(content, suffix, dpi):
        if content == b"!":
            raise OSError("unreadable")
        return content.split(b"|")

    rows = files.pages(files.binary_files(spark, str(tmp_path)), render, 300)
    assert sorted((r["source_id"], r["page_number"], r["error"]) for r in rows.collect() if r["error"]) == [("bad.txt", None, "OSError")]
    tokens = files.recognise(rows, lambda: lambda image: [{"text": image.decode(), "confidence": 0.5, "left": 1, "top": 2, "width": 3, "height": 4}])
    assert sorted((r["page_number"], r["text"], r["box"]["top"]) for r in tokens.collect()) == [(1, "one", 2), (2, "two", 2)]
    with pytest.raises(ValueError):
        files.pages(rows, render, 10)


def test_recogniser_columns(spark):
    pages = spark.createDataFrame([("d", 1, ["a", " ", "b"], ["95", "1", "-1"], ["1", "2", "x"], ["1", "2", "3"], ["1", "2", "3"], ["1", "2", "3"])], "document_id string, page_number int, text array<string>, conf array<string>, left array<string>, top array<string>, width array<string>, height array<string>")
    got = [(r["text"], r["confidence"], r["box"]) for r in extraction.regions_from_columns(pages).orderBy("region_number").collect()]
    assert got[0][:2] == ("a", 0.95) and tuple(got[0][2]) == (1, 1, 1, 1) and got[1] == ("b", None, None)


def test_contained_paths():
    assert files.contained("a/b.png", "/root/x") == "/root/x/a/b.png"
    with pytest.raises(ValueError):
        files.contained("../y", "/root/x")


def test_manifest_and_pairs(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"samples": [{"id": "1", "text": "a"}, {"id": "2", "text": "b"}]}))
    assert files.manifest(spark, str(tmp_path / "m.json"), "id:string,text:string").count() == 2
    one, two = spark.createDataFrame([("/i/a.png",)], "path string"), spark.createDataFrame([("/m/a.tif",), ("/m/b.tif",)], "path string")
    assert files.image_mask_pairs(one, two.limit(1)).count() == 1
    with pytest.raises(Exception, match="no partner"):
        files.image_mask_pairs(one, two).collect()


def test_uploads(spark):
    rows = [("DOCUMENT", "application/PDF", 5, None, "a.pdf"), ("GIS", "application/pdf", 5, None, "a"), ("GIS", "application/zip", 0, None, "a"), ("GIS", "application/zip", 1, "zz", "a"), ("GIS", "application/zip", 1, None, "a/b")]
    df = spark.createDataFrame(rows, "c string, t string, s long, h string, n string")
    assert [r[0] for r in df.select(files.upload_refusal(*map(F.col, "ctshn"))).collect()] == [None, "CONTENT_TYPE", "SIZE", "CHECKSUM", "FILE_NAME"]


def test_exports_refuse_to_overwrite(spark, tmp_path):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]
    rows = spark.createDataFrame([("p1", "12/3", "DRAFT", "UNVERIFIED", ring), ("p2", "9", "DRAFT", "UNVERIFIED", None)], "parcel_id string, external_identifier string, status string, verification_status string, ring array<struct<x:double,y:double>>")
    features = sinks.parcel_features(rows)
    sinks.write_features(features, str(tmp_path / "f"))
    (line,) = [r[0] for r in spark.read.text(str(tmp_path / "f")).collect()]
    feature = json.loads(line)
    assert feature["geometry"]["coordinates"][0][2] == [1.0, 1.0] and feature["properties"]["preliminary"] is True and feature["properties"]["legal_boundary_asserted"] is False
    with pytest.raises(Exception):
        sinks.write_features(features, str(tmp_path / "f"))
    assert json.loads(sinks.collection(features).first()[0])["features"][0]["id"] == "p1"
    many = spark.range(57).selectExpr("id", "concat('{\"id\":', id, '}') AS value")
    with pytest.raises(Exception, match="more than 56"):
        sinks.collection(many, 56).collect()
    pages = sinks.pages(many, "id", 10).orderBy("page").collect()
    assert [x["id"] for p in pages for x in json.loads(p["value"])["features"]] == list(range(57)) and max(len(json.loads(p["value"])["features"]) for p in pages) <= 10
    assert [p["page"] for p in pages] == list(range(len(pages))) and pages[0]["after"] is None and pages[1]["after"] == json.loads(pages[0]["value"])["features"][-1]["id"]


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    rows.limit(1).write.parquet(path)
    for _ in range(2):
        sinks.append_once(spark.read.parquet(path), rows, ["k"], path)
    assert spark.read.parquet(path).count() == 2


def test_masks_and_their_ranges(spark, tmp_path):
    for name, grid in (("a.npy", np.array([[0, 255], [51, 102]], np.uint8)), ("b.npy", np.zeros((2, 2, 3))), ("c.npy", np.full((1, 2, 1), 0.5, np.float32)), ("d.npy", np.array([[None]], object))):
        np.save(tmp_path / name, grid)
    (tmp_path / "e.png").write_bytes(b"?")
    found = files.masks(files.binary_files(spark, str(tmp_path)))
    got = {r["source_id"]: r for r in found.withColumn("p", raster.probabilities(F.col("values"))).collect()}
    assert (got["a.npy"]["height"], got["a.npy"]["width"], got["a.npy"]["p"]) == (2, 2, [0.0, 1.0, 0.2, 0.4])
    assert (got["c.npy"]["height"], got["c.npy"]["values"]) == (1, [0.5, 0.5])
    assert {k: r["error"] for k, r in got.items()} == {"a.npy": None, "b.npy": "ValueError", "c.npy": None, "d.npy": "ValueError", "e.png": "ValueError"}
    decoded = files.masks(files.binary_files(spark, str(tmp_path), "*.png"), lambda content, suffix: [[len(content)]]).first()
    assert (decoded["values"], decoded["error"]) == ([1.0], None)
    odd = spark.createDataFrame([(1, []), (2, None), (3, [0.1, None]), (4, [float("nan")]), (5, [300.0]), (6, [-1.0, 2.0]), (7, [-0.1]), (8, [0.0, 1.0])], "k int, v array<double>")
    assert {r["k"]: r["why"] for r in odd.select("k", raster.mask_refusal(F.col("v")).alias("why")).collect()} == {1: "NO_VALUES", 2: "NO_VALUES", 3: "NON_FINITE", 4: "NON_FINITE", 5: "OUT_OF_RANGE", 6: "OUT_OF_RANGE", 7: "NEGATIVE", 8: None}


def test_originals_are_never_replaced(spark):
    existing = spark.createDataFrame([("k1",)], "storage_key string")
    objects = spark.createDataFrame([("k1", "t", b"x"), ("k2", "t", b"y"), ("k2", "t", b"y"), ("k3", None, b"")], "storage_key string, content_type string, content binary")
    got = sorted((r["storage_key"], r["size_bytes"], r["refused"]) for r in sinks.private_objects(existing, objects).collect())
    assert got == [("k1", 1, True), ("k2", 1, False), ("k2", 1, True), ("k3", 0, False)]
