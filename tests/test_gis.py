import json

import pytest
from pyspark.sql import functions as F

from terrafold.functions import geojson as J
from terrafold.operators import gis

KINDS = {
    "Point": [1.5, 2], "MultiPoint": [[1, 2], [3, 4]], "LineString": [[0, 0], [1, 1], [2, 0]], "MultiLineString": [[[0, 0], [1, 1]], [[5, 5], [6, 6.25]]],
    "Polygon": [[[0, 0], [9, 0], [9, 9], [0, 9], [0, 0]], [[2, 2], [2, 4], [4, 4], [2, 2]]], "MultiPolygon": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [9, 5], [9, 9], [5, 5]], [[7, 6], [8, 7], [8, 6], [7, 6]]]],
}


def read(spark, texts, expected="Polygon"):
    df = J.read(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t", expected)
    return [(r["unreadable"], r["properties"], r["back"]) for r in df.withColumn("back", J.text(F.col("geometry"))).orderBy("k").collect()]


def test_round_trip_of_every_kind(spark):
    objects = [{"type": kind, "coordinates": c} for kind, c in KINDS.items()]
    texts = [json.dumps(o) for o in objects]
    texts += [json.dumps({"type": "Feature", "properties": {"a": 1}, "geometry": o}) for o in objects]
    texts += [json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": None, "geometry": o}]}, indent=1) for o in objects]
    got = read(spark, texts)
    assert [json.loads(b) for _, _, b in got] == objects * 3 and {r for r, _, _ in got} == {None}
    assert json.loads(got[6][1]) == {"a": 1} and got[12][1] is None


def test_odd_texts(spark):
    cases = {
        None: "NOT_AN_OBJECT", "": "NOT_AN_OBJECT", "[1,2]": "NOT_AN_OBJECT", "{broken": "NOT_AN_OBJECT", "{}": "NO_GEOMETRY", '{"type":"Feature","geometry":null}': "NO_GEOMETRY",
        '{"type":"FeatureCollection","features":[]}': "NOT_ONE_FEATURE", '{"type":"FeatureCollection","features":[{"geometry":{"type":"Point","coordinates":[1,2]}},{}]}': "NOT_ONE_FEATURE",
        '{"type":"GeometryCollection","coordinates":[1]}': "UNKNOWN_KIND", '{"type":"Polygon","coordinates":[]}': "EMPTY_GEOMETRY", '{"type":"LineString","coordinates":[[1],[2,3]]}': "BAD_COORDINATES",
        '{"type":"LineString","coordinates":"x"}': "BAD_COORDINATES", '{"type":"LineString","coordinates":[[1,"a"],[2,3]]}': "BAD_COORDINATES", '{"type":"Polygon","coordinates":[[1,2],[3,4]]}': "BAD_COORDINATES",
    }
    assert [r for r, _, _ in read(spark, list(cases))] == list(cases.values())
    bare = read(spark, ['{"coordinates":[[0,0,7],[20,0,7]],"coordinate_space":"PIXEL"}'], "LineString")
    assert json.loads(bare[0][2]) == {"type": "LineString", "coordinates": [[0, 0], [20, 0]]}


LINE = {"type": "LineString", "coordinates": [[500000, 3000000], [500010, 3000000]]}
POLYGON = {"type": "Polygon", "coordinates": [[[500000, 3000000], [500010, 3000000], [500010, 3000010], [500000, 3000010], [500000, 3000000]]]}
HOLED = {"type": "Polygon", "coordinates": [*POLYGON["coordinates"], [[500002, 3000002], [500004, 3000002], [500004, 3000004], [500002, 3000004], [500002, 3000002]]]}
BOW = {"type": "Polygon", "coordinates": [[[500000, 3000000], [500010, 3000010], [500010, 3000000], [500000, 3000010], [500000, 3000000]]]}


def table(spark, rows, kind):
    return spark.createDataFrame([(k, s, c, json.dumps(p), crs) for k, (s, c, p, crs) in enumerate(rows)], f"feature_id int, source string, {kind} string, payload string, source_crs string")


def test_roads(spark):
    surface = {"type": "Feature", "properties": {"road_surface": True, "source_crs": "EPSG:32618"}, "geometry": HOLED}
    rows = [
        ("EXISTING_GIS", "ROAD", LINE, "EPSG:32618"), ("EXISTING_GIS", "ROAD", {"type": "LineString", "coordinates": [[77.0, 28.0], [77.001, 28.0]]}, "EPSG:4326"),
        ("MANUAL_DRAWN", "PATHWAY", {"coordinates": [[0, 0], [20, 0]], "coordinate_space": "PIXEL"}, None), ("MANUAL_DRAWN", "ROAD", {"coordinates": [[0, 0]]}, None),
        ("AI_CANDIDATE", "ACCESS_CORRIDOR", LINE, "EPSG:32618"), ("EXISTING_GIS", "ROAD", surface, None), ("EXISTING_GIS", "ROAD", POLYGON, "EPSG:32618"), ("EXISTING_GIS", "ROAD", {"type": "MultiLineString", "coordinates": [LINE["coordinates"]]}, None),
        ("EXISTING_GIS", "RAIL", LINE, None),
    ]
    got = gis.roads(table(spark, rows, "road_class")).orderBy("feature_id").collect()
    assert [r["refusal"] for r in got] == [None, None, None, "TOO_FEW_POINTS", None, None, "NOT_A_ROAD_GEOMETRY", "MULTILINE_NOT_ALLOWED", "UNKNOWN_CLASS"]
    assert got[0]["length_m"] == pytest.approx(10) and 90 < got[1]["length_m"] < 110 and got[2]["length_m"] is None and got[2]["coordinate_space"] == "PIXEL"
    assert (got[4]["status"], got[4]["verification_status"], got[4]["ai_status"], got[4]["warnings"]) == ("DRAFT", "UNVERIFIED", "AI_PRELIMINARY", [gis.ROAD_WARNING])
    assert (got[5]["geometry_kind"], got[5]["coordinate_space"], got[5]["length_m"]) == ("SURFACE", "WORLD", pytest.approx(48))


def test_land_use_measures_holes_and_repairs(spark):
    two = {"type": "MultiPolygon", "coordinates": [HOLED["coordinates"], [[[x + 100, y] for x, y in ring] for ring in POLYGON["coordinates"]]]}
    rows = [("EXISTING_GIS", "VACANT", p, "EPSG:32618") for p in (POLYGON, HOLED, BOW, two, LINE)] + [("MANUAL_DRAWN", "UNKNOWN", {"coordinates": POLYGON["coordinates"], "coordinate_space": "LOCAL"}, None)]
    rows += [("EXISTING_GIS", "VACANT", {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [2, 2], [0, 0]]]}, None)]
    got = gis.land_use(table(spark, rows, "land_use_class"), allow_multipolygon=True).orderBy("feature_id").collect()
    assert [r["area_m2"] for r in got[:4]] == [pytest.approx(x) for x in (100, 96, 50, 196)] and got[1]["area_sqft"] == pytest.approx(96 * 10.7639104167)
    assert [r["refusal"] for r in got] == [None, None, None, None, "NOT_A_POLYGON", None, "INVALID_GEOMETRY"]
    assert got[2]["repaired"] and got[2]["geometry"]["kind"] == "MultiPolygon" and not got[1]["repaired"] and got[5]["area_m2"] is None
    refused = gis.land_use(table(spark, rows[3:4], "land_use_class")).first()
    assert refused["refusal"] == "MULTIPOLYGON_NOT_ALLOWED" and refused["geometry"] is None


def test_collections_go_out_in_degrees(spark):
    rows = [("EXISTING_GIS", "VACANT", HOLED, "EPSG:32618"), ("EXISTING_GIS", "VACANT", {"coordinates": HOLED["coordinates"], "coordinate_space": "LOCAL"}, None), ("NOBODY", "VACANT", HOLED, None)]
    out = [json.loads(r["value"]) for r in gis.collections(gis.land_use(table(spark, rows, "land_use_class"))).orderBy("feature_id").collect()]
    assert len(out) == 2
    world, local = out
    assert world["metadata"]["export_crs"] == "EPSG:4326" and world["features"][0]["properties"]["source_crs"] == "EPSG:32618" and world["features"][0]["properties"]["crs"] == "EPSG:4326"
    rings = world["features"][0]["geometry"]["coordinates"]
    assert len(rings) == 2 and all(-75.01 < x < -74.99 and 27.1 < y < 27.2 for ring in rings for x, y in ring)
    assert local["features"][0]["geometry"] == {"type": "Polygon", "coordinates": [[[float(v) for v in p] for p in ring] for ring in HOLED["coordinates"]]} and local["metadata"]["export_crs"] is None


def test_other_systems_measure_in_their_units(spark):
    feet = "+proj=lcc +lat_1=10 +lat_2=20 +lat_0=12 +lon_0=78 +units=ft"
    box = {"type": "Polygon", "coordinates": [[[0, 0], [100, 0], [100, 100], [0, 100], [0, 0]]]}
    area = gis.land_use(table(spark, [("EXISTING_GIS", "VACANT", box, feet), ("EXISTING_GIS", "VACANT", box, "EPSG:3857"), ("EXISTING_GIS", "VACANT", box, "EPSG:99999")], "land_use_class")).orderBy("feature_id")
    assert [r["area_m2"] for r in area.collect()] == [pytest.approx(10_000 * 0.3048**2), pytest.approx(10_000), None]
    (first, _, last) = (json.loads(r["value"]) for r in gis.collections(area).orderBy("feature_id").collect())
    assert first["features"][0]["geometry"]["coordinates"][0][0] == pytest.approx([78, 12]) and last["metadata"]["export_crs"] is None
    road = gis.roads(table(spark, [("EXISTING_GIS", "ROAD", {"coordinates": [[0, 0], [30, 40]]}, feet)], "road_class")).first()
    assert road["length_m"] == pytest.approx(50 * 0.3048)


def test_no_rows(spark):
    assert gis.collections(gis.roads(table(spark, [], "road_class"))).count() == 0
