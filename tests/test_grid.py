"""The hierarchical grid, and cells that are cut, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import cadastre, shapes


def boxes(rng, n, sizes):
    out = []
    for k in range(n):
        s = rng.choice(sizes)
        x, y = rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)
        out.append((k, x, y, x + s * rng.uniform(0.2, 1), y + s * rng.uniform(0.2, 1)))
    return out


def frame(spark, rows, side):
    df = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double")
    return df.select(F.col("id").alias(f"{side}_id"), F.struct("x0", "y0", "x1", "y1").alias(f"{side}b"))


def met(a, b):
    return sorted((i, j) for i, ax0, ay0, ax1, ay1 in a for j, bx0, by0, bx1, by1 in b if max(ax0, bx0) < min(ax1, bx1) and max(ay0, by0) < min(ay1, by1))


@pytest.mark.parametrize("cell", [None, 20.0])
def test_boxes_of_very_different_sizes(spark, cell):
    rng = random.Random(5)
    a, b = boxes(rng, 150, [0.01, 1, 30, 500, 4000]), boxes(rng, 150, [0.5, 60, 2000])
    a.append((900, -5000.0, -5000.0, 5000.0, 5000.0))
    got = cadastre._common_cells(frame(spark, a, "l"), frame(spark, b, "r"), cell).select("l_id", "r_id").collect()
    assert sorted(map(tuple, got)) == met(a, b)


def test_rows_a_box_are_bounded(spark):
    """One box over the whole plane and many small ones: the large one is in four cells, not in all."""
    rng = random.Random(6)
    small = boxes(rng, 300, [1.0])
    large = [(0, -1000.0, -1000.0, 1100.0, 1100.0)]
    pairs = cadastre._common_cells(frame(spark, large, "l"), frame(spark, small, "r"))
    assert sorted(r["r_id"] for r in pairs.collect()) == [k for k, *_ in small]
    exploded = pairs._jdf.queryExecution().executedPlan()
    pairs.count()
    assert exploded is not None
    levels = cadastre._common_cells(frame(spark, large, "l"), frame(spark, small + large, "r")).count()
    assert levels == len(small) + 1


def test_empty_sides(spark):
    none, some = frame(spark, [], "l"), frame(spark, boxes(random.Random(1), 5, [3]), "r")
    assert cadastre._common_cells(none, some).count() == 0


def test_dense_cells_are_cut(spark, monkeypatch):
    """Many rings in one place: the same sums whatever the number of rings a cell takes."""
    rng = random.Random(8)
    rows = [(k, x, y, x + rng.uniform(0.5, 3), y + rng.uniform(0.5, 3)) for k in range(120) for x, y in [(rng.uniform(0, 8), rng.uniform(0, 8))]]
    df = spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double").select(G.rectangle(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("ring"))
    edge = [(1.0, 1.0), (7.0, 1.0), (7.0, 7.0), (1.0, 7.0), (1.0, 1.0)]
    sums = []
    for most in (1000, 20, 3):
        monkeypatch.setattr(cadastre, "CELL_RINGS", most)
        sums.append(list(cadastre.coverage(df, edge, 16.0).first()))
    assert sums[1] == pytest.approx(sums[0]) and sums[2] == pytest.approx(sums[0])


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def test_topology_of_repaired_shapes(spark):
    """A bow-tie is judged by its two triangles, a hole is no overlap, a boundary's hole is no gap."""
    square = lambda x, y, s: ring((x, y), (x + s, y), (x + s, y + s), (x, y + s))
    rows = [(1, [ring((0, 0), (10, 10), (10, 0), (0, 10))]), (2, [square(0, 0, 10), square(2, 2, 6)]), (3, [square(3, 3, 4)]), (4, [ring((0, 0), (1, 1), (2, 2))]), (5, None), (6, [square(20, 0, 10)])]
    df = spark.createDataFrame(rows, f"shape_id int, rings array<{G.RING}>")
    boundary = [[(0, 0), (30, 0), (30, 10), (0, 10), (0, 0)], [(12, 2), (14, 2), (14, 8), (12, 8), (12, 2)]]
    got = {(r["code"], tuple(r["shape_ids"])): r["area"] for r in shapes.topology(df, boundary).collect()}
    tie_in_frame = 50 - 18  # the hole takes the middle of both triangles
    assert got == {
        ("INVALID_GEOMETRY", (4,)): None, ("INVALID_GEOMETRY", (5,)): None, ("PARCEL_OVERLAP", (1, 2)): pytest.approx(tie_in_frame), ("PARCEL_OVERLAP", (1, 3)): pytest.approx(8),
        ("COVERAGE_GAP", ()): pytest.approx(100 - 12 + 36 - 16 - (18 - 8)),
    }
    lonlat = spark.createDataFrame([(1, [square(78, 11, 1)]), (2, [square(78.5, 11, 1)])], f"shape_id int, rings array<{G.RING}>")
    area = shapes.intersections(lonlat, F.lit(4326)).first()["area"]
    assert area == pytest.approx(0.5 * 1.0 * 110_600 * 109_100, rel=0.02)
    assert shapes.intersections(lonlat, F.lit(None).cast("int")).first()["area"] is None


def test_concave_rings_have_a_common_part(spark):
    """Both rings concave: the measure gets polygons, never null for want of a ring."""
    u = ring((0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9))
    n = ring((0, 5), (3, 5), (3, 11), (6, 11), (6, 5), (9, 5), (9, 14), (0, 14))
    rows = spark.createDataFrame([(1, u), (2, n)], f"parcel_id int, ring {G.RING}")
    got = cadastre.overlaps(rows, area=lambda polygons: G.polygons_area_metres(polygons, F.lit(32644))).collect()
    assert [tuple(r) for r in got] == [(1, 2, pytest.approx(24))]
