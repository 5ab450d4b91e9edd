"""Shapes with holes, parts and crossings against counting of points and plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import shapes

SHAPE = "shape_id int, rings array<array<struct<x:double,y:double>>>"


def closed(points):
    return [*points, points[0]]


def odd(rings, x, y):
    """Whether an odd number of edges cross the ray upwards from each point."""
    inside = np.zeros(len(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:]):
            spans = (ax <= x) != (bx <= x)
            with np.errstate(divide="ignore", invalid="ignore"):
                inside ^= spans & (ay + (x - ax) * (by - ay) / (bx - ax) > y)
    return inside


@pytest.mark.parametrize("seed", range(12))
def test_pieces_cover_the_even_odd_inside_once(seed):
    rng = np.random.default_rng(seed)
    shift = np.array([500000.0, 1400000.0]) if seed % 2 else np.zeros(2)
    rings = [np.array(closed(rng.integers(0, 12, (rng.integers(3, 9), 2)).tolist()), float) + shift for _ in range(rng.integers(1, 4))]
    parts = G.even_odd_pieces(rings)
    at = rng.uniform(0, 12, (4000, 2)) + shift
    covered = sum((odd([p], at[:, 0], at[:, 1]).astype(int) for p in parts), np.zeros(4000, int))
    assert (covered == odd(rings, at[:, 0], at[:, 1])).all()
    assert all(G._is_convex(np.round(p - shift, 6)) for p in parts)


def test_repair_and_odd_rows(spark):
    square = closed([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])
    hole = closed([(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)])
    across = closed([(3.0, 1.0), (6.0, 1.0), (6.0, 2.0), (3.0, 2.0)])
    far = closed([(8.0, 0.0), (9.0, 0.0), (9.0, 1.0)])
    rows = spark.createDataFrame([(1, [square, hole, far]), (2, [square, across]), (3, []), (4, None), (5, [square, square]), (6, [square[:2]])], SHAPE)
    got = {r["shape_id"]: (r["status"], round(r["area"], 9)) for r in shapes.normalized(rows).collect()}
    assert got == {1: ("VALID", 15.5), 2: ("REPAIRED", 17.0), 3: ("EMPTY_GEOMETRY", 0.0), 4: ("EMPTY_GEOMETRY", 0.0), 5: ("EMPTY_GEOMETRY", 0.0), 6: ("EMPTY_GEOMETRY", 0.0)}
    pairs = [tuple(r) for r in shapes.overlaps(rows).collect()]
    # of what 2 takes of the square (without 3..4 x 1..2), 1 lacks its hole
    assert [(a, b, round(x, 9)) for a, b, x in pairs] == [(1, 2, 14.0)]
    assert shapes.overlaps(rows.limit(0)).count() == 0
    # 2 fills the hole of 1, and 1 the one of 2
    for some, want in ((rows, (16.0, 0.0, 2.5)), (rows.filter("shape_id = 1"), (15.0, 1.0, 0.5))):
        cover = shapes.union_coverage(some, square).first()
        assert tuple(round(cover[c], 9) for c in ("covered_m2", "gap_m2", "outside_m2")) == want


def test_parts_of_unequal_length(spark):
    parts = [closed([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), closed([(8.0, 0.0), (9.0, 0.0), (9.0, 1.0)])]
    row = spark.createDataFrame([(1, parts, 32644), (2, None, 32644), (3, [], None)], SHAPE + ", crs int")
    got = row.select("shape_id", G.are_valid_polygons(F.col("rings")).alias("ok"), G.parts_area(F.col("rings"), F.col("crs")).alias("area"), G.parts_length(F.col("rings"), F.col("crs")).alias("length")).orderBy("shape_id").collect()
    assert [(r["ok"], r["area"]) for r in got] == [(True, 16.5), (False, None), (False, None)]
    assert got[0]["length"] == pytest.approx(16 + 2 + 2**0.5) and got[1]["length"] is None
