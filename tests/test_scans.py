import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import raster as R
from terrafold.operators import scans


def frame(spark, images):
    rows = [(k, y, [int(v) for v in line]) for k, image in images.items() for y, line in enumerate(image)]
    return spark.createDataFrame(rows, "image_id long, row long, levels array<int>").repartition(3)


def grids(df):
    out = {}
    for r in df.orderBy("image_id", "row").collect():
        out.setdefault(r["image_id"], []).append(r["levels"])
    return {k: np.array(v) for k, v in out.items()}


def turned(image, degrees):
    """Pixel by pixel: cubic interpolation of the 4 x 4 pixels around where each comes from."""
    h, w = image.shape
    s, c = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
    out = np.full((h, w), 255)

    def cubic(p, t):
        return p[1] + t * (p[2] - p[0] + t * (2 * (p[0] - p[1]) + p[2] - p[3] + t * (p[1] - p[0] + p[3] - p[2])))

    for y in range(h):
        for x in range(w):
            u, v = x + 0.5 - w / 2, y + 0.5 - h / 2
            px, py = c * u - s * v + w / 2, s * u + c * v + h / 2
            if 0 <= px < w and 0 <= py < h:
                fx, fy = math.floor(px - 0.5), math.floor(py - 0.5)
                near = [[image[min(max(fy + j, 0), h - 1), min(max(fx + i, 0), w - 1)] for i in range(-1, 3)] for j in range(-1, 3)]
                value = cubic([cubic(line, px - 0.5 - fx) for line in near], py - 0.5 - fy)
                out[y, x] = min(255, max(0, math.floor(value + 0.5)))
    return out


def test_rotation_equals_loops_over_pixels(spark):
    rng = np.random.default_rng(1)
    images = {1: rng.integers(0, 256, (37, 52)), 2: rng.integers(0, 256, (20, 9)), 3: rng.integers(0, 256, (5, 5)), 4: rng.integers(0, 256, (1, 1))}
    degrees = {1: 7.3, 2: -14.9, 3: None, 4: 45.0}
    df, angles = frame(spark, images), spark.createDataFrame(list(degrees.items()), "image_id long, degrees double")
    for block in (8, 128):
        got = grids(scans.rotated(df, angles, block))
        for k, image in images.items():
            want = image if degrees[k] is None else turned(image, degrees[k])
            assert got[k].shape == want.shape and np.abs(got[k] - want).max() <= (1 if degrees[k] else 0)


def test_quarter_turns_are_exact(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (16, 16))
    df = frame(spark, {1: image, 2: image})
    got = grids(scans.rotated(df, spark.createDataFrame([(1, 180.0), (2, 90.0)], "image_id long, degrees double"), 5))
    inner = slice(1, -1)  # rounding decides whether edge pixels lie inside
    assert (got[1][inner, inner] == image[::-1, ::-1][inner, inner]).all() and (got[2][inner, inner] == np.rot90(image)[inner, inner]).all()


@pytest.mark.parametrize("angle", [6.0, -9.0])
def test_a_tilted_line_of_text_comes_level(spark, angle):
    h, w = 60, 160
    y, x = np.mgrid[0:h, 0:w] + 0.5
    off = np.abs((y - h / 2) - math.tan(math.radians(angle)) * (x - w / 2))
    rng = np.random.default_rng(5)
    page = np.where((off < 3) & (np.abs(x - w / 2) < 60), rng.integers(125, 150, (h, w)), rng.integers(215, 235, (h, w)))
    made, seen = scans.prepared(frame(spark, {1: page}), threshold=True)
    assert seen.first()["degrees"] == pytest.approx(angle, abs=0.7)
    level = grids(made)[1]
    assert set(np.unique(level)) == {0, 255}
    rows = np.flatnonzero((level == 0).sum(1) > 40)
    assert 3 <= len(rows) <= 9 and abs(rows.mean() + 0.5 - h / 2) < 1.5  # a level bar
    assert abs(R.skew(made).first()["degrees"] or 0) < 0.8


def test_steps_can_be_left_out(spark):
    rng = random.Random(4)
    page = np.array([[rng.randint(0, 255) for _ in range(6)] for _ in range(5)])
    made, seen = scans.prepared(frame(spark, {1: page}), contrast=False, denoise=False, deskew=False)
    assert (grids(made)[1] == page).all() and seen.first()["degrees"] is None
    empty = spark.createDataFrame([], "image_id long, row long, levels array<int>")
    assert scans.prepared(empty)[0].count() == 0
