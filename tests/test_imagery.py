import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import png
from terrafold.functions.geometry import RING
from terrafold.operators import imagery


def decode(data):
    """Pixels of a PNG by the format's rules, one byte at a time."""
    assert data[:8] == png.SIGNATURE
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", part[:10])
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    colours, raw, out = 3 if colour == 2 else 1, zlib.decompress(body), []
    for y in range(height):
        line = raw[y * (width * colours + 1) :][: width * colours + 1]
        row = []
        for k, v in enumerate(line[1:]):
            left, above = row[k - colours] if k >= colours else 0, out[-1][k] if out else 0
            row.append((v + (0, left, above)[line[0]]) % 256)
        out.append(row)
    return np.array(out, np.uint8).reshape((height, width, 3) if colours == 3 else (height, width))


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (9, 4, 3), (40, 40, 3)])
def test_files_decode_to_their_pixels(shape):
    rng = np.random.default_rng(1)
    for pixels in (rng.integers(0, 256, shape), np.zeros(shape), np.cumsum(np.ones(shape), axis=1)):
        assert (decode(png.encode(pixels.astype(np.uint8))) == pixels.astype(np.uint8)).all()


def rasters_of(spark, grids, side, nodata=None):
    tiles = [(r, b, x, y, min(side, g.shape[1] - x), g[y : y + side, x : x + side].ravel().tolist()) for r, bands in grids.items() for b, g in enumerate(bands, 1) for y in range(0, g.shape[0], side) for x in range(0, g.shape[1], side)]
    sizes = [(r, bands[0].shape[1], bands[0].shape[0], nodata) for r, bands in grids.items()]
    return (
        spark.createDataFrame(tiles, "raster_id long, band int, x0 long, y0 long, width long, values array<double>").repartition(3),
        spark.createDataFrame(sizes, "raster_id long, width long, height long, nodata double"),
    )


def shown(band, most, nodata=None):
    """A band's preview by loops over pixels."""
    h, w = band.shape
    width, height = imagery.preview_size(w, h, most)
    total, weight = np.zeros((height, width)), np.zeros((height, width))
    for y in range(h):
        for x in range(w):
            for v in range(int(y * height / h), min(height, int(np.ceil((y + 1) * height / h)))):
                for u in range(int(x * width / w), min(width, int(np.ceil((x + 1) * width / w)))):
                    share = (min((y + 1) * height / h, v + 1) - max(y * height / h, v)) * (min((x + 1) * width / w, u + 1) - max(x * width / w, u))
                    if share > 0 and np.isfinite(band[y, x]) and band[y, x] != nodata:
                        total[v, u] += share * band[y, x]
                        weight[v, u] += share
    mean = np.where(weight > 1e-12, total / np.maximum(weight, 1e-300), np.nan)
    if np.isnan(mean).all():
        return mean, np.zeros(mean.shape, int)
    low, high = np.percentile(mean[~np.isnan(mean)], (2, 98))
    high = high if high > low else low + 1
    return mean, np.where(np.isnan(mean), 0, np.clip((mean - low) * 255 / (high - low), 0, 255)).astype(int)


@pytest.mark.parametrize("side", [64, 7])
def test_previews_equal_loops_over_pixels(spark, side):
    rng = np.random.default_rng(2)
    rgb = [rng.uniform(0, 1000, (21, 30)) for _ in range(4)]
    grey = [np.where(rng.random((11, 9)) < 0.2, -1.0, rng.uniform(5, 6, (11, 9)))]
    grey[0][3:5] = np.nan
    tiles, rasters = rasters_of(spark, {1: rgb, 2: grey, 3: [np.full((4, 4), 7.0)], 4: [np.full((2, 2), -1.0)]}, side, nodata=-1.0)
    got = {r["raster_id"]: r for r in imagery.previews(tiles, rasters, 13).collect()}
    assert set(got) == {1, 2, 3} and (got[1]["width"], got[1]["height"]) == (13, 9)
    for r, bands in ((1, rgb[:3]), (2, grey * 3), (3, [np.full((4, 4), 7.0)] * 3)):
        picture = decode(got[r]["png"]).astype(int)
        for c, band in enumerate(bands):
            assert np.abs(picture[:, :, c] - shown(band, 13, -1.0)[1]).max() <= 1


def test_filled_pixels_equal_point_tests():
    rng = random.Random(3)
    for _ in range(20):
        rings = [np.array([*(pts := [(rng.uniform(-3, 18), rng.uniform(-3, 18)) for _ in range(rng.randint(3, 9))]), pts[0]]) for _ in range(rng.randint(1, 3))]
        want = {(y, x) for y in range(15) for x in range(-4, 20) if sum((a[1] <= y + 0.5) != (b[1] <= y + 0.5) and x + 0.5 >= a[0] + (y + 0.5 - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for r in rings for a, b in zip(r[:-1], r[1:])) % 2}
        assert {(y, x) for y, a, b in imagery.spans_inside(rings, 15) for x in range(a, b)} == want
        thick = rng.choice([2, 4, 5])
        near = set()
        for r in rings:
            for a, b in zip(r[:-1], r[1:]):
                for y in range(15):
                    for x in range(-8, 24):
                        d, v = b - a, np.array([x + 0.5, y + 0.5]) - a
                        t = min(1, max(0, v @ d / (d @ d)))
                        if ((v - t * d) ** 2).sum() <= (thick / 2) ** 2:
                            near.add((y, x))
        assert {(y, x) for y, a, b in imagery.spans_along(rings, thick, 15) for x in range(a, b)} == near


def test_outlines_lie_on_pictures(spark):
    tiles, rasters = rasters_of(spark, {1: [np.arange(1600.0).reshape(40, 40)], 2: [np.zeros((4, 4))]}, 16)
    ring = [{"x": float(x), "y": float(y)} for x, y in [(8, 8), (32, 8), (32, 32), (8, 32), (8, 8)]]
    features = spark.createDataFrame([(1, 1, [[ring]]), (1, 2, None), (3, 1, [[ring]])], f"raster_id long, number long, polygons array<array<{RING}>>")
    got = {r["raster_id"]: decode(r["png"]) for r in imagery.overlays(tiles, rasters, features, 20, fill=(1, 2, 3)).collect()}
    plain = {r["raster_id"]: decode(r["png"]) for r in imagery.previews(tiles, rasters, 20).collect()}
    assert set(got) == {1, 2} and (got[2] == plain[2]).all()
    assert tuple(got[1][10, 4]) == imagery.OUTLINE and tuple(got[1][10, 2]) == imagery.RIM and tuple(got[1][10, 10]) == (1, 2, 3)
    assert (got[1][0] == plain[1][0]).all() and (got[1][:, 19] == plain[1][:, 19]).all()


def test_training_samples(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(24):
        h, w = rng.integers(2, 7, 2)
        rows.append((f"s{k}", int(h), int(w), bytearray(rng.integers(0, 256, 3 * h * w).astype(np.uint8)), bytearray(rng.integers(0, 2, h * w).astype(np.uint8) * 200)))
    df = spark.createDataFrame([*rows, ("bad", 2, 2, bytearray(b"abc"), bytearray(b"abcd")), ("none", None, 1, None, None)], "sample_id string, height int, width int, image binary, mask binary")
    got = {r["sample_id"]: r for r in imagery.training_samples(df, augment=True, seed=3).collect()}
    assert got["bad"]["image"] is None and got["none"]["mask"] is None and len({r["turned"] for r in got.values()} - {None}) == 8
    for name, h, w, image, mask in rows:
        rgb, grey, r = np.frombuffer(bytes(image), np.uint8).reshape(h, w, 3), np.frombuffer(bytes(mask), np.uint8).reshape(h, w), got[name]
        back = np.array(r["image"], np.float32).reshape(3, r["height"], r["width"]).transpose(1, 2, 0) * np.array(imagery.IMAGE_STD) + np.array(imagery.IMAGE_MEAN)
        back, m = np.rot90(back, -(r["turned"] & 3)), np.rot90(np.array(r["mask"]).reshape(r["height"], r["width"]), -(r["turned"] & 3))
        if r["turned"] & 4:
            back, m = back[:, ::-1], m[:, ::-1]
        assert np.abs(back * 255 - rgb).max() < 0.01 and (m == (grey > 0)).all()
    again = {r["sample_id"]: r["turned"] for r in imagery.training_samples(df.repartition(5), augment=True, seed=3).collect()}
    assert again == {k: r["turned"] for k, r in got.items()}
    small = {r["sample_id"]: r for r in imagery.training_samples(df, size=4).collect()}
    assert all(len(r["image"]) == 48 and len(r["mask"]) == 16 for k, r in small.items() if k.startswith("s"))
    assert (imagery.resize_weights(6, 6) == np.eye(6)).all() and np.allclose(imagery.resize_weights(8, 2)[0], np.array([5, 7, 7, 5, 3, 1, 0, 0]) / 28)
    flat = imagery.resize_weights(5, 13) @ np.full(5, 9.0)
    assert np.allclose(flat, 9)


def test_prediction_records(spark):
    df = spark.createDataFrame([("a", 2, [0.9, 0.1, 0.5, 0.2]), ("b", 2, []), ("c", 1, [0.1]), ("d", None, None)], "sample_id string, width int, values array<double>")
    got = {r["sample_id"]: r for r in imagery.prediction_records(df).collect()}
    assert (got["a"]["mean_probability"], got["a"]["predicted_fraction"]) == (pytest.approx(0.7), 0.5) and decode(bytes(got["a"]["mask_png"])).tolist() == [[255, 0], [255, 0]]
    assert got["b"]["mask_png"] is None and (got["c"]["mean_probability"], got["c"]["predicted_fraction"]) == (0.0, 0.0) and got["d"]["mask_png"] is None
