import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import overlay as O
from terrafold.functions.raster import components as by_pixels
from terrafold.operators import graph, mosaic


def cut(grid, side, raster=1):
    h, w = grid.shape
    return [(raster, x, y, min(side, w - x), grid[y : y + side, x : x + side].ravel().tolist()) for y in range(0, h, side) for x in range(0, w, side)]


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "raster_id long, x0 long, y0 long, width long, values array<double>").repartition(3)
    out = mosaic.vectorize(df, **how).withColumn("area", O.polygons_area(F.col("polygons")))
    return {(r["raster_id"], r["component"]): r for r in out.collect()}


@pytest.mark.parametrize("share", [0.2, 0.45, 0.7])
def test_any_tiling_gives_the_same_as_none(spark, share):
    rng = np.random.default_rng(int(share * 100))
    grid = np.where(rng.random((23, 31)) < share, rng.uniform(0.5, 1, (23, 31)), 0.1)
    labels = by_pixels(grid >= 0.5)
    want = {}
    for k in range(1, labels.max() + 1):
        y, x = np.argwhere(labels == k)[0]
        want[1, int(y) * 2**32 + int(x)] = (int((labels == k).sum()), float(grid[labels == k].mean()))
    seen = []
    for side in (64, 10, 3, 1):
        got = found(spark, cut(grid, side))
        assert {k: r["pixels"] for k, r in got.items()} == {k: n for k, (n, _) in want.items()}
        assert all(r["area"] == r["pixels"] and r["confidence"] == pytest.approx(want[k][1]) for k, r in got.items())
        seen.append({k: r["polygons"] for k, r in got.items()})
    assert seen[0] == seen[1] == seen[2] == seen[3]


def test_runs_are_labelled_as_pixels_are():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        mask = rng.random((rng.integers(1, 40), rng.integers(1, 40))) < rng.uniform(0.1, 0.9)
        row, first, end = mosaic.runs_of(mask)
        label = mosaic.label_runs(row, first, end, mask.shape[1])
        image = np.zeros(mask.shape, int)
        for r, a, b, k in zip(row, first, end, label):
            image[r, a:b] = k + 1
        pixels = by_pixels(mask)
        assert ((image > 0) == mask).all() and len({*zip(image[mask].tolist(), pixels[mask].tolist())}) == len(set(pixels[mask].tolist())) == len(set(label.tolist()))
    spiral = np.zeros((41, 41), bool)  # one long run of turns
    for k in range(0, 20, 2):
        spiral[k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = spiral[k + 2 : 41 - k, k] = True
        spiral[k + 2, k : k + 3] = True
    assert len(set(mosaic.label_runs(*mosaic.runs_of(spiral), 41).tolist())) == by_pixels(spiral).max()


def test_ring_over_four_tiles_has_a_hole(spark):
    grid = np.zeros((8, 8))
    grid[1:7, 1:7] = 1
    grid[3:5, 3:5] = 0
    (one,) = found(spark, cut(grid, 4)).values()
    assert [len(p) for p in one["polygons"]] == [2] and one["area"] == 32 and [len(r) for r in one["polygons"][0]] == [5, 5]


def test_odd_tiles_and_rasters(spark):
    rows = [(1, 0, 0, 2, [0.9, 0.1, 0.1, 0.9]), (2, 0, 0, 2, [0.9, 0.9]), (3, 0, 0, 2, None), (4, 0, 0, 2, []), (None, 0, 0, 1, [1.0]), (5, 0, 0, 2, [None, float("nan")]), (6, 5, 7, 1, [1.0])]
    got = found(spark, rows)
    assert {k: r["pixels"] for k, r in got.items()} == {(1, 0): 2, (2, 0): 2, (6, 7 * 2**32 + 5): 1}
    assert len(got[1, 0]["polygons"]) == 2  # corners touch: one component, two polygons
    assert found(spark, rows, min_pixels=2).keys() == {(1, 0), (2, 0)} and found(spark, []) == {}


def test_components_within_groups(spark):
    rng = random.Random(2)
    links = [(g, rng.randint(-50, 50), rng.randint(-50, 50)) for g in range(4) for _ in range(40)] + [(9, k, k + 1) for k in range(60)] + [(8, 2**63 - 1, -(2**63)), (8, 2**63 - 1, 2**63 - 2)]
    got = {(r["g"], r["node"]): r["component"] for r in graph.components(spark.createDataFrame(links, "g int, a long, b long"), "g", "a", "b").collect()}
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for g, a, b in links:
        if a != b:
            x, y = sorted((root((g, a)), root((g, b))))
            parent[y] = x
    assert got == {k: root(k)[1] for k in parent}
