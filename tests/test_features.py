"""Features and a project's pages on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from terrafold.operators import cadastre, features, projects


def test_buildings_by_plain_counting(spark):
    # a ring of eight pixels round a hole, and a single pixel
    mask = [0.9, 0.9, 0.9, 0.0, 0.0] + [0.9, 0.0, 0.9, 0.0, 0.6] + [0.9, 0.9, 0.9, 0.0, 0.0]
    parts = cadastre.vectorize(spark.createDataFrame([(1, mask)], "mask_id long, values array<double>"), 5)
    pixel = {r["component"]: r for r in features.buildings(parts).collect()}
    assert sorted(round(r["confidence"], 6) for r in pixel.values()) == [0.6, 0.9]
    assert all(r["coordinate_space"] == "PIXEL" and r["area_m2"] is None and r["source_crs"] is None for r in pixel.values())
    world = features.buildings(parts, (2.0, 0.0, 500000.0, 0.0, -2.0, 1400000.0), "EPSG:32644").collect()
    assert sorted(r["area_m2"] for r in world) == [4.0, 32.0]
    assert {(p["x"], p["y"]) for r in world if r["area_m2"] == 4.0 for p in r["ring"]} == {(500008.0, 1399998.0), (500010.0, 1399998.0), (500008.0, 1399996.0), (500010.0, 1399996.0)}
    assert [r["area_m2"] for r in features.buildings(parts, (2.0, 0.0, 500000.0, 0.0, -2.0, 1400000.0), "EPSG:32644", min_area=5).collect()] == [32.0]
    assert features.buildings(parts, min_area=2).count() == 1
    line = json.loads(features.geojson(features.buildings(parts), F.col("component"), "ring", ["status", "confidence", "area_m2"]).first()["value"])
    assert line["geometry"]["type"] == "Polygon" and line["properties"]["status"] == "AI_PRELIMINARY" and line["properties"]["area_m2"] is None


POINTS = "array<array<struct<x:double,y:double>>>"


def test_roads_and_land_use_with_nulls(spark):
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]
    rows = spark.createDataFrame(
        [(1, "MANUAL_DRAWN", "ROAD", "Polygon", square, True, "EPSG:32644", None), (2, None, None, None, None, None, None, None), (3, "AI_CANDIDATE", "ROAD", None, square, None, None, "PIXEL"), (4, "AI_CANDIDATE", "PATHWAY", "MultiLineString", [[(0.0, 0.0), (3.0, 4.0)]] * 2, None, "EPSG:32644", None)],
        f"feature_id int, source string, road_class string, kind string, parts {POINTS}, road_surface boolean, source_crs string, coordinate_space string",
    )
    got = {r["feature_id"]: r for r in features.roads(rows, allow_multiline=True).collect()}
    assert (got[1]["geometry_kind"], got[1]["length_m"], got[1]["coordinate_space"], got[1]["verification_status"]) == ("SURFACE", 8.0, "WORLD", "UNVERIFIED")
    assert [got[k]["refusal"] for k in (1, 2, 3, 4)] == [None, "UNKNOWN_SOURCE", "NOT_A_ROAD_GEOMETRY", None]
    assert got[2]["status"] is None and (got[4]["length_m"], got[4]["ai_status"]) == (10.0, "AI_PRELIMINARY")
    land = {r["feature_id"]: r for r in features.land_use(rows.withColumn("land_use_class", F.when(F.col("feature_id") != 3, "VACANT"))).collect()}
    assert land[1]["area_m2"] == 4.0 and [land[k]["refusal"] for k in (2, 3, 4)] == ["UNKNOWN_SOURCE", "UNKNOWN_CLASS", "NOT_A_POLYGON"]


def test_search_keeps_to_its_budget(spark):
    documents = spark.createDataFrame([(k, f"deed {k}", "VALIDATED" if k % 2 else None, k) for k in range(6)], "document_id long, name string, status string, updated_at int")
    parcels = spark.createDataFrame([(1, None, "DRAFT", None, 1), (2, "deed-9", "DRAFT", None, 1)], "parcel_id long, external_identifier string, status string, verification_status string, updated_at int")
    fields = spark.createDataFrame([(10 * d + k, d, "owner_details", k, "deed") for d in (4, 5) for k in (0, 1)], "field_id long, document_id long, field_name string, candidate_index int, original_value string")
    said = spark.createDataFrame([(50, 1, "deed b"), (51, 1, "deed c"), (51, 2, "deed d")], "field_id long, version int, corrected_value string")
    hits = projects.search(documents, parcels, fields, said, " DEED ", limit=30).collect()
    assert [(r["kind"], r["id"]) for r in hits[:7]] == [*(("DOCUMENT", k) for k in (5, 4, 3, 2, 1, 0)), ("PARCEL", 2)]
    assert hits[6]["preliminary"] is True
    assert sorted((r["evidence_id"], r["matched_value"]) for r in hits[7:]) == [(40, "deed"), (50, "deed"), (51, "deed d")]
    assert projects.search(documents, parcels, fields, said, "deed", limit=6).count() == 6
    assert projects.search(documents, parcels, fields, said, "deed", read_fields=False).count() == 7
    # of eight, one is left for fields: one document's first candidate
    assert [r["evidence_id"] for r in projects.search(documents, parcels, fields, said, "deed", limit=8).collect()][7:] == [50]
    assert projects.search(documents.limit(0), parcels.limit(0), fields.limit(0), said.limit(0), "deed").count() == 0
    with pytest.raises(ValueError):
        projects.search(documents, parcels, fields, said, "x")


def test_dashboard_of_projects_without_rows(spark):
    empty = lambda schema: spark.createDataFrame([], "project_id long, " + schema)
    rows = projects.dashboard(
        spark.createDataFrame([(1,), (2,)], "project_id long"), spark.createDataFrame([(1, 7, None), (1, 8, "VALIDATED")], "project_id long, document_id long, status string"), empty("document_id long, link_status string"),
        empty("status string, queue_type string, target_type string, severity string, assignee_id long"), empty("status string"), empty("status string, job_type string"), empty("kind string"), me=1,
    ).orderBy("project_id").collect()
    assert (rows[0]["documents"], rows[0]["validated_records"], rows[0]["unlinked_validated_records"], rows[0]["open_reviews"]) == (2, 1, 1, 0)
    assert rows[1]["documents"] == 0 and rows[1]["document_statuses"] == []


def test_run_meets_the_newest_issue_of_a_key(spark):
    evidence = spark.createDataFrame([(1, "survey_number", 0, "A/1", "A / 1"), (2, "khata_number", 0, "A/1", "a/1"), (2, "survey_number", 1, "", " "), (3, "village", 0, "A/1", "A/1")], "document_id long, field_name string, candidate_index int, identifier string, value string")
    areas = spark.createDataFrame([(5, 100.0, 130.0), (6, 100.0, 101.0), (7, 0.0, 9.0), (8, None, 9.0)], "link_id long, document_area_m2 double, parcel_area_m2 double")
    old = spark.createDataFrame([("area-mismatch:5", "LOW", "a", "OPEN", 1), ("area-mismatch:5", "LOW", "b", "RESOLVED", 2)], "issue_key string, severity string, summary string, status string, created_at int")
    issues = projects.validation_run(evidence, areas, old)
    got = sorted((r["issue_key"], r["severity"], r["status"], r["outcome"]) for r in issues.collect())
    assert got == [("area-mismatch:5", "LOW", "OPEN", "kept"), ("area-mismatch:5", "LOW", "RESOLVED", "left"), ("duplicate-record:A/1", "HIGH", "OPEN", "created")]
    assert issues.filter("outcome = 'created'").first()["summary"] == "Potential duplicate record: 2 validated documents share identifier A / 1."
    assert projects.run_counters(issues).first().asDict() == {"created": 1, "refreshed": 0, "open_issues": 2, "duplicate_records": 1, "area_mismatches": 1}
    assert projects.mismatch_issues(areas).first()["summary"].endswith("differ by 23.1%.")
