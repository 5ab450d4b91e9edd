import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.functions import raster as R
from terrafold.operators import cadastre


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))


def test_planar_and_edit_functions(spark):
    df = frame(spark, [(SQUARE,)], f"r {G.RING}")
    r = F.col("r")
    area, length, n, edge = df.select(G.planar_area(r), G.planar_length(r), G.distinct_points(r), G.nearest_edge(r, G.point(F.lit(5), F.lit(2)))).first()
    assert (area, length, n, edge) == (16.0, 16.0, 4, 1)
    moved = df.select(G.planar_area(G.replace_vertex(r, F.lit(0), G.point(F.lit(-4), F.lit(0)))), G.planar_area(G.insert_vertex(r, F.lit(0), G.point(F.lit(2), F.lit(-2)))), G.planar_area(G.remove_vertex(r, F.lit(0)))).first()
    assert tuple(moved) == (24.0, 20.0, 8.0)
    triangle = frame(spark, [(ring((0, 0), (1, 0), (0, 1), (0, 0)),)], f"r {G.RING}")
    assert triangle.select(F.size(G.remove_vertex(r, F.lit(0)))).first()[0] == 4


def test_ellipsoid():
    # one degree of latitude at the equator, and a cell of one by one degree there
    assert G.ellipsoid_distance(0, 0, 0, 1) == pytest.approx(110574.3886, abs=1e-3)
    assert G.ellipsoid_distance(0, 0, 1, 0) == pytest.approx(111319.4908, abs=1e-3)
    cell = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float)
    assert G.ellipsoid_area(cell) == pytest.approx(12308778361.469, rel=2e-4)
    whole = 4 * math.pi * G.WGS84_A**2 * float(G.authalic_q(np.array(1.0))) / 2
    assert whole == pytest.approx(510065621724088, rel=1e-6)


def test_small_rings_and_rings_around_a_pole(spark):
    # a metre or so across, anywhere: the plane's area by the radii of curvature there
    for lon, lat in ((0.0, 0.0), (179.99999, 45.0), (-120.0, -60.0)):
        d = 1e-5
        cell = np.array([(lon, lat), (lon + d, lat), (lon + d, lat + d), (lon, lat + d), (lon, lat)])
        s2 = math.sin(math.radians(lat + d / 2)) ** 2
        m, n = G.WGS84_A * (1 - G.WGS84_E2) / (1 - G.WGS84_E2 * s2) ** 1.5, G.WGS84_A / math.sqrt(1 - G.WGS84_E2 * s2)
        assert G.ellipsoid_area(cell) == pytest.approx(math.radians(d) ** 2 * m * n * math.cos(math.radians(lat + d / 2)), rel=1e-6)
    # around the pole the band down to the equator is measured, wherever the ring begins
    pole = np.array([(x, 80.0) for x in range(0, 360, 10)] + [(0.0, 80.0)])
    turned = np.vstack([pole[7:-1], pole[:8]])
    assert G.ellipsoid_area(pole) == pytest.approx(G.ellipsoid_area(turned), rel=1e-9)
    rows = spark.createDataFrame([(1, None, 4326), (2, [], 4326), (3, [(0.0, 0.0), (0.0, 1.0)], 4326), (4, [(0.0, 0.0), (3.0, 4.0)], 32644), (5, [(0.0, 0.0), (3.0, 4.0)], None)], f"k int, r {G.RING}, code int")
    got = rows.orderBy("k").select(G.length_metres(F.col("r"), F.col("code")), G.area_square_metres(F.col("r"), F.col("code"))).collect()
    assert [(None if x is None else round(x, 3), y) for x, y in got] == [(None, None), (None, None), (110574.389, None), (5.0, None), (None, None)]


@pytest.mark.parametrize("code", [32644, 32744, 6933])
def test_projections_round_trip(code):
    lat = np.linspace(-60, -1, 7) if code == 32744 else np.linspace(1, 60, 7)
    points = np.column_stack([np.linspace(78.2, 83.5, 7), lat])
    assert np.allclose(G.unproject(G.project(points, code), code), points, atol=1e-9)
    if code == 6933:
        box = np.array([(80, 10), (80.01, 10), (80.01, 10.01), (80, 10.01), (80, 10)])
        p = G.project(box, code)
        planar = abs(np.sum(p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1])) / 2
        assert planar == pytest.approx(G.ellipsoid_area(box), rel=1e-5)


def test_utm_central_meridian():
    x, y = G.project(np.array([(81.0, 0.0)]), 32644)[0]
    assert (x, y) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))


def test_measures_need_a_known_system(spark):
    rows = [(1, ring((80, 10), (80.001, 10), (80.001, 10.001), (80, 10.001), (80, 10)), "EPSG:4326"), (2, SQUARE, "EPSG:32644"), (3, SQUARE, "EPSG:3857"), (4, [], "EPSG:4326")]
    df = frame(spark, rows, f"k int, r {G.RING}, crs string").withColumn("code", G.crs_code(F.col("crs")))
    got = {r["k"]: (r["a"], r["l"]) for r in df.select("k", G.area_square_metres(F.col("r"), F.col("code")).alias("a"), G.length_metres(F.col("r"), F.col("code")).alias("l")).collect()}
    assert got[1][0] == pytest.approx(12120, rel=1e-2) and got[2] == (16.0, 16.0) and got[3] == (None, None) and got[4] == (None, None)


def test_validity(spark):
    rows = [(1, SQUARE), (2, ring((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))), (3, ring((0, 0), (4, 0), (0, 0))), (4, ring((0, 0), (4, 0), (2, 0), (0, 0)))]
    df = frame(spark, rows, f"k int, r {G.RING}")
    assert [r[0] for r in df.orderBy("k").select(G.is_valid_polygon(F.col("r"))).collect()] == [True, False, False, False]


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    boxes = [(k, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(0.5, 12), rng.uniform(0.5, 12)) for k in range(150)]
    rows = [(k, ring((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))) for k, x, y, w, h in boxes]
    got = {(r["left_id"], r["right_id"]): r["area_m2"] for r in cadastre.overlaps(frame(spark, rows, f"parcel_id int, ring {G.RING}")).collect()}
    want = {}
    for i, (a, ax, ay, aw, ah) in enumerate(boxes):
        for b, bx, by, bw, bh in boxes[i + 1 :]:
            w, h = min(ax + aw, bx + bw) - max(ax, bx), min(ay + ah, by + bh) - max(ay, by)
            if w > 0 and h > 0 and w * h > 0.01:
                want[a, b] = w * h
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_topology_and_unified_issues(spark):
    rows = [("a", SQUARE), ("b", ring((2, 2), (6, 2), (6, 6), (2, 6), (2, 2))), ("c", ring((0, 0), (4, 4), (4, 0), (0, 4), (0, 0)))]
    issues = cadastre.topology_issues(frame(spark, rows, f"parcel_id string, ring {G.RING}"))
    got = sorted((r["code"], r["parcel_ids"], r["area_m2"]) for r in issues.collect())
    assert got == [("INVALID_GEOMETRY", ["c"], None), ("PARCEL_OVERLAP", ["a", "b"], 4.0)]
    unified = cadastre.unified_issues(issues)
    assert sorted((r["entity_id"], r["severity"], r["review_required"]) for r in unified.collect()) == [("a", "MEDIUM", True), ("b", "MEDIUM", True), ("c", "HIGH", True)]


def test_disjoint_parcels_have_no_overlap_area(spark):
    rows = [(1, SQUARE, ring((2, 0), (6, 0), (6, 4), (2, 4), (2, 0))), (2, SQUARE, ring((9, 9), (10, 9), (10, 10), (9, 10), (9, 9)))]
    got = {r["k"]: r for r in cadastre.compare(frame(spark, rows, f"k int, reference {G.RING}, candidate {G.RING}")).collect()}
    assert (got[1]["overlap_area"], got[1]["symmetric_difference"], got[1]["hausdorff"]) == (8.0, 16.0, 2.0)
    assert got[2]["overlap_area"] is None and got[2]["symmetric_difference"] == 17.0


def test_coverage(spark):
    box = lambda a, b, c, d: ring((a, b), (c, b), (c, d), (a, d), (a, b))
    rows = frame(spark, [(box(0, 0, 6, 10),), (box(4, 0, 12, 5),), (box(4, 0, 12, 5),)], f"ring {G.RING}")
    edge = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    for cell in (None, 3.0, 100.0):
        assert [round(v, 9) for v in cadastre.coverage(rows, edge, cell).first()] == [80.0, 20.0, 10.0]


def test_coverage_of_concave_and_slanted_rings_equals_counted_points(spark):
    rng = random.Random(8)

    def star(x, y):
        n, at = rng.randint(4, 9), []
        for k in range(n):
            far, turn = rng.uniform(1, 4), 2 * math.pi * k / n
            at.append((x + far * math.cos(turn), y + far * math.sin(turn)))
        return [*at, at[0]]

    stars = [star(rng.uniform(0, 14), rng.uniform(0, 14)) for _ in range(12)]
    edge = [(1, 1), (12, 0), (13, 12), (7, 6), (2, 13), (1, 1)]

    def within(points, r):
        inside = np.zeros(len(points), bool)
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            if ay != by:
                hit = (ay > points[:, 1]) != (by > points[:, 1])
                inside ^= hit & (points[:, 0] < (bx - ax) * (points[:, 1] - ay) / (by - ay) + ax)
        return inside

    side = np.arange(-6, 20, 0.02) + 0.01
    points = np.stack(np.meshgrid(side, side), -1).reshape(-1, 2)
    covered, bound = np.any([within(points, s) for s in stars], axis=0), within(points, edge)
    rows = frame(spark, [(ring(*s),) for s in stars], f"ring {G.RING}")
    for cell in (2.5, None):
        got = cadastre.coverage(rows, edge, cell).first()
        assert got["covered_m2"] == pytest.approx((covered & bound).sum() * 0.0004, abs=0.05)
        assert got["gap_m2"] == pytest.approx((~covered & bound).sum() * 0.0004, abs=0.05)
        assert got["outside_m2"] == pytest.approx((covered & ~bound).sum() * 0.0004, abs=0.05)


def test_topology_meets_a_boundary(spark):
    shape = ring((0, 0), (4, 0), (4, 4), (2, 4), (2, 2), (0, 2), (0, 0))
    rows = frame(spark, [("a", shape), ("b", ring((4, 0), (6, 0), (6, 4), (4, 4), (4, 0)))], f"parcel_id string, ring {G.RING}")
    issues = cadastre.topology_issues(rows, [(0, 0), (5, 0), (5, 4), (0, 4), (0, 0)])
    assert sorted((r["code"], r["parcel_ids"], round(r["area_m2"], 9)) for r in issues.collect()) == [("COVERAGE_GAP", [], 4.0), ("OUTSIDE_PROJECT_BOUNDARY", ["b"], 4.0)]


def test_acquisition_refusals(spark):
    pts = ring((0, 0), (10, 0), (10, 5))
    rows = [("a", "GNSS_SURVEY", None, None, None, None, pts), ("b", "MANUAL_DRAWING", None, "SPACE", None, None, SQUARE), ("c", "AI_VISIBLE_BOUNDARY", None, None, None, "NO_VISIBLE_EVIDENCE", None), ("d", "MANUAL_DRAWING", "EPSG:32644", None, 1.5, None, SQUARE)]
    df = frame(spark, rows, f"parcel_id string, source string, source_crs string, coordinate_space string, confidence double, evidence_type string, ring {G.RING}")
    got = {r["parcel_id"]: r for r in cadastre.acquire(df).collect()}
    assert got["a"]["status"] == "DRAFT" and len(got["a"]["ring"]) == 4 and got["a"]["area_m2"] is None
    assert got["b"]["refusal"] == "UNKNOWN_COORDINATE_SPACE" and got["d"]["refusal"] == "CONFIDENCE_RANGE"
    assert (got["c"]["status"], got["c"]["requires_survey"]) == ("NOT_DETERMINED", True)


def test_images(spark):
    bins = spark.createDataFrame([("a", 10, 5), ("a", 12, 5), ("a", 200, 5), ("a", 205, 5), ("b", 7, 9), ("b", 9, 0)], "image string, level int, n long")
    assert {r["image"]: r["threshold"] for r in R.otsu(bins, "image").collect()} == {"a": 12, "b": 127}
    rng = np.random.default_rng(2)
    gray = rng.integers(0, 256, (7, 9))
    images = spark.createDataFrame([(1, y, row.tolist()) for y, row in enumerate(gray)], "image_id int, row int, levels array<int>")
    back = lambda df: np.array([r["levels"] for r in df.orderBy("row").collect()])
    wide = np.pad(gray, 1, mode="edge")
    assert (back(R.smoothed(images)) == [[np.median(wide[y : y + 3, x : x + 3]) for x in range(9)] for y in range(7)]).all()
    middle = math.floor(gray.mean() + 0.5)
    assert (back(R.contrasted(images)) == np.clip(np.floor(middle + 1.5 * (gray - middle)), 0, 255)).all()
    level = R.otsu(R.histogram(images), "image_id").first()["threshold"]
    assert (back(R.two_levels(images)) == np.where(gray > level, 255, 0)).all()
    page = np.full((60, 200), 255)
    for x in range(200):
        page[20 + round(x * math.tan(math.radians(3))) : 24 + round(x * math.tan(math.radians(3))), x] = 5 + x % 50  # the level must part darker from lighter ink, as it is exclusive
    pages = spark.createDataFrame([(1, y, row.tolist()) for y, row in enumerate(page)] + [(2, y, [255] * 9) for y in range(9)], "image_id int, row int, levels array<int>")
    turned = {r["image_id"]: r["degrees"] for r in R.skew(pages).collect()}
    assert turned[1] == pytest.approx(3, abs=0.3) and turned[2] is None


def test_masks():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 1, 0]], bool)
    labels = R.components(mask)
    assert labels.max() == 3 and labels[0, 0] == labels[1, 1] != labels[0, 3]
    donut = np.ones((3, 3), bool)
    donut[1, 1] = False
    rings = R.outlines(donut)
    assert len(rings) == 2 and len(rings[0]) == 5
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2
    assert sum(area(r) for r in rings) == 8
    for k in range(1, 4):
        assert sum(area(r) for r in R.outlines(labels == k)) == (labels == k).sum()


def test_empty_masks_score_perfect(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 5), (0, 5, 0)], "tp long, fp long, fn long")
    rows = df.select(*R.segmentation_scores(F.col("tp"), F.col("fp"), F.col("fn"))).collect()
    assert tuple(rows[0]) == (1.0, 1.0, 1.0, 1.0) and rows[1]["precision"] == 0.0 and rows[2]["recall"] == 1.0


def test_concave_rings_overlap_by_their_common_area(spark):
    u = ring((0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0))
    inside = ring((2.5, 3), (3.5, 3), (3.5, 9), (9, 9), (9, 10), (2.5, 10), (2.5, 3))  # in the gap of the u, touches nothing
    across = ring((1, 3), (5, 3), (5, 5), (3, 5), (3, 4), (1, 4), (1, 3))
    rows = [(1, u), (2, inside), (3, across[::-1])]
    got = {(r["left_id"], r["right_id"]): r["area_m2"] for r in cadastre.overlaps(frame(spark, rows, f"parcel_id int, ring {G.RING}")).collect()}
    # 3 with the u: 1 by 1 on the left, 1 by 2 on the right; with 2: from 2.5 to 3.5 by 1, and half of that above
    assert got == pytest.approx({(1, 3): 3.0, (2, 3): 1.5})
    far = [(k, [{"x": p["x"] + 500_000, "y": p["y"] + 4_000_000} for p in r]) for k, r in rows]
    assert {(r["left_id"], r["right_id"]): r["area_m2"] for r in cadastre.overlaps(frame(spark, far, f"parcel_id int, ring {G.RING}")).collect()} == pytest.approx(got)


def test_edits_meet_the_boundary_and_their_neighbours(spark):
    box = lambda a, b, c, d: ring((a, b), (c, b), (c, d), (a, d), (a, b))
    edits = [
        (1, "p", box(0, 0, 10, 10), box(0, 0, 10, 10)), (2, "p", box(10, 0, 20, 10), box(9.8, 0, 19.8, 10)), (3, "p", box(20, 0, 30, 10), box(20.2, 0, 30.2, 10)),
        (4, "q", box(0, 0, 10, 10), box(0, 0, 12, 10)), (5, "p", box(0, 20, 1, 21), box(0, 20, 0, 21)),
    ]
    rows = frame(spark, edits, f"parcel_id int, project_id string, before {G.RING}, after {G.RING}")
    bent = ring((0, 0), (30, 0), (30, 40), (-5, 40), (-5, 30), (0, 30), (0, 0))
    boundaries = frame(spark, [("p", bent)], f"project_id string, ring {G.RING}")
    neighbours = frame(spark, [(1, box(0, 0, 10, 10)), (2, box(10, 0, 20, 10)), (3, box(20, 0, 30, 10))], f"parcel_id int, ring {G.RING}")
    got = {(r["parcel_id"], r["code"], r["neighbour_id"]): r["area_m2"] and round(r["area_m2"], 6) for r in cadastre.edit_issues(rows, boundaries, neighbours).collect()}
    assert got == {
        (2, "NEIGHBOUR_OVERLAP", 1): 2.0, (3, "OUTSIDE_PROJECT_BOUNDARY", None): 2.0, (4, "SIGNIFICANT_AREA_CHANGE", None): 20.0, (4, "NEIGHBOUR_OVERLAP", 1): 100.0,
        (4, "NEIGHBOUR_OVERLAP", 2): 20.0, (5, "INVALID_EDIT_GEOMETRY", None): None,
    }
