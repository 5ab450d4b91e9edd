import random

import numpy as np
import pytest

from terrafold.functions import overlay as O


def closed(points):
    return np.array([*points, points[0]], float)


def inside(rings, p):
    """Even-odd by a ray, for points off all edges."""
    n = 0
    for r in rings:
        for (ax, ay), (bx, by) in zip(r[:-1], r[1:]):
            n += (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax
    return bool(n % 2)


def area(polygons):
    total = 0.0
    for polygon in polygons:
        for k, r in enumerate(polygon):
            own = float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2
            assert (own > 0) == (k == 0), "outer rings go left, holes right"
            total += own
    return total


def check(a, b, points):
    """All four operations against membership of points, and areas that add up."""
    made = {how: O.combine([a, b], rule) for how, rule in O.RULES.items()}
    for p in points:
        x, y = inside(a, p), inside(b, p)
        want = {"union": x or y, "intersection": x and y, "difference": x and not y, "symmetric_difference": x != y}
        for how, polygons in made.items():
            hits = [inside(polygon, p) for polygon in polygons]
            assert sum(hits) == want[how], (how, p)
    size = {how: area(polygons) for how, polygons in made.items()}
    assert size["union"] == pytest.approx(size["intersection"] + size["symmetric_difference"], rel=1e-6, abs=1e-9)
    for polygons in made.values():
        for polygon in polygons:
            for ring in polygon:
                assert (ring[0] == ring[-1]).all() and len(np.unique(ring[:-1], axis=0)) == len(ring) - 1
    return made


SQUARE = [closed([(0, 0), (8, 0), (8, 8), (0, 8)])]
FRAME = [*SQUARE, closed([(2, 2), (6, 2), (6, 6), (2, 6)])]
CONCAVE = [closed([(1, -1), (9, -1), (9, 9), (7, 9), (7, 1), (3, 1), (3, 9), (1, 9)])]
PARTS = [closed([(0, 0), (1, 0), (1, 1)]), closed([(4, 4), (12, 4), (12, 12), (4, 12)])]
BOW = [closed([(0, 0), (8, 8), (8, 0), (0, 8)])]


@pytest.mark.parametrize("a", [SQUARE, FRAME, CONCAVE, PARTS, BOW])
@pytest.mark.parametrize("b", [SQUARE, FRAME, CONCAVE, PARTS, BOW, []])
def test_pairs_equal_point_tests(a, b):
    rng = random.Random(1)
    check(a, b, [(rng.uniform(-2, 13), rng.uniform(-2, 13)) for _ in range(150)])


def test_known_outlines():
    union = O.combine([SQUARE, [closed([(8, 0), (12, 0), (12, 8), (8, 8)])]], O.RULES["union"])
    assert [r.tolist() for r in union[0]] == [[[0, 0], [12, 0], [12, 8], [0, 8], [0, 0]]] and len(union) == 1
    bow = O.combine([BOW], O.RULES["union"])
    assert [[r.tolist() for r in p] for p in bow] == [[[[0, 0], [4, 4], [0, 8], [0, 0]]], [[[4, 4], [8, 0], [8, 8], [4, 4]]]]
    frame = O.combine([FRAME], O.RULES["union"])
    assert len(frame) == 1 and len(frame[0]) == 2 and area(frame) == 48
    # a hole that touches its outer ring in a point, and an island in a hole
    touching = O.combine([[*SQUARE, closed([(0, 4), (2, 3), (2, 5)])]], O.RULES["union"])
    assert len(touching) == 1 and len(touching[0]) == 2
    island = O.combine([[*FRAME, closed([(3, 3), (5, 3), (5, 5), (3, 5)])]], O.RULES["union"])
    assert sorted(len(p) for p in island) == [1, 2] and area(island) == 52
    # equal shapes
    assert O.combine([FRAME, FRAME], O.RULES["symmetric_difference"]) == [] and area(O.combine([FRAME, FRAME], O.RULES["intersection"])) == 48
    # given corners come back to the digit
    odd = [closed([(78.1234567, 11.7654321), (78.1299999, 11.7654321), (78.13, 11.77)])]
    assert {tuple(p) for p in O.combine([odd], O.RULES["union"])[0][0].tolist()} == {tuple(p) for p in odd[0].tolist()}


def test_nothing_has_no_outline():
    for rings in ([], [np.zeros((0, 2))], [closed([(0, 0), (1, 1)])], [closed([(0, 0), (1, 1), (2, 2)])], [closed([(0, 0), (np.nan, 1), (2, 0)])], [np.zeros((5, 2))]):
        assert O.combine([rings], O.RULES["union"]) == []


@pytest.mark.parametrize("seed", range(12))
def test_random_stars_and_tangles(seed):
    rng = random.Random(seed)

    def star(n, tangle):
        angles = [rng.uniform(0, 2 * np.pi) for _ in range(n)]
        if not tangle:
            angles.sort()
        x, y = rng.uniform(0, 4), rng.uniform(0, 4)
        return closed([(x + rng.uniform(1, 6) * np.cos(t), y + rng.uniform(1, 6) * np.sin(t)) for t in angles])

    a, b = ([star(rng.randint(3, 25), rng.random() < 0.5) for _ in range(rng.randint(1, 3))] for _ in range(2))
    check(a, b, [(rng.uniform(-4, 9), rng.uniform(-4, 9)) for _ in range(200)])


@pytest.mark.parametrize("seed", range(8))
def test_whole_coordinates_with_shared_lines(seed):
    """Rectangles on a small grid lie on each other's edges and corners all the time."""
    rng = random.Random(100 + seed)

    def boxes(n):
        out = []
        for _ in range(n):
            x, y = rng.randint(0, 6), rng.randint(0, 6)
            w, h = rng.randint(1, 4), rng.randint(1, 4)
            out.append(closed([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]))
        return out

    a, b = boxes(rng.randint(1, 5)), boxes(rng.randint(1, 5))
    grid = [(x + 0.5, y + 0.5) for x in range(-1, 12) for y in range(-1, 12)]
    made = check(a, b, grid)
    assert area(made["intersection"]) == sum(inside(a, p) and inside(b, p) for p in grid)


def test_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, FRAME, CONCAVE), (2, BOW, SQUARE), (3, [], SQUARE), (4, None, SQUARE)]
    told = [(k, *(None if s is None else [[{"x": float(x), "y": float(y)} for x, y in r] for r in s] for s in pair)) for k, *pair in rows]
    df = spark.createDataFrame(told, f"id int, a array<{O.RING}>, b array<{O.RING}>")
    got = df.select("id", *(O.polygons_area(O.overlay(how)(F.col("a"), F.col("b"))).alias(how) for how in O.RULES), O.polygons_area(O.outline(F.col("a"))).alias("own"), F.size(O.dissolved(F.array("a", "b"))).alias("parts")).orderBy("id").collect()
    for r, (_, a, b) in zip(got, rows):
        for how, rule in O.RULES.items():
            assert r[how] == (None if a is None else pytest.approx(area(O.combine([a, b], rule))))
    assert [r["own"] for r in got] == [48, 32, 0, None] and got[1]["parts"] == 1


def off(points, ring):
    a, d = ring[:-1], np.diff(ring, axis=0)
    v = points[:, None] - a
    t = np.clip((v * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return float(np.hypot(*np.moveaxis(v - t[:, :, None] * d, 2, 0)).min(1).max())


@pytest.mark.parametrize("seed", range(6))
def test_simplified_rings_stay_within_the_tolerance(seed):
    rng = random.Random(seed)
    angles = sorted(rng.uniform(0, 2 * np.pi) for _ in range(120))
    ring = closed([(r * np.cos(t), r * np.sin(t)) for t in angles for r in [10 + rng.uniform(0, 1)]])
    hole = closed([(3 * np.cos(t), 3 * np.sin(t)) for t in angles][::-1])
    for tolerance in (0.05, 0.5, 2.5):
        (made,) = O.simplify([[ring, hole]], set(), tolerance)
        for old, new in zip((ring, hole), made):
            assert len(new) <= len(old) and off(old, new) <= tolerance + 1e-9 and {tuple(p) for p in new.tolist()} <= {tuple(p) for p in old.tolist()}
        assert not O._crossing(made) and area([made]) > 0
        assert len(made[0]) < len(ring)


def test_neighbours_still_fit_when_a_layer_is_simplified(spark):
    from pyspark.sql import functions as F

    from terrafold.operators import shapes

    rng = random.Random(7)
    wave = [(5 + rng.uniform(-0.4, 0.4) * (0 < k < 40), k / 4) for k in range(41)]
    left, right = closed([(0, 0), *wave, (0, 10)]), closed([(10, 0), (10, 10), *wave[::-1]])
    alone = closed([(20 + 2 * np.cos(t), 2 * np.sin(t)) for t in np.linspace(0, 2 * np.pi, 60, endpoint=False)])
    rows = [(k, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in [ring]]]) for k, ring in enumerate((left, right, alone))] + [(3, []), (4, None)]
    df = spark.createDataFrame(rows, f"shape_id int, polygons array<array<{O.RING}>>")
    got = {r["shape_id"]: r for r in shapes.simplify_layer(df, 0.3).withColumn("area", O.polygons_area(F.col("polygons"))).collect()}
    points = lambda k: {(p["x"], p["y"]) for p in got[k]["polygons"][0][0]}
    shared = {p for p in points(0) if 0 < p[0] < 10}
    assert shared == {p for p in points(1) if 0 < p[0] < 10} and 2 < len(shared) < 41
    assert got[0]["area"] + got[1]["area"] == pytest.approx(100) and len(points(2)) < 30 and got[3]["polygons"] == [] and got[4]["polygons"] is None
