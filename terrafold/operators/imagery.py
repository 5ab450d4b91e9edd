"""Pictures of rasters: previews by area averaging, outlines and fills of features on them, and training samples.

Rasters come as tiles (raster_id, band from 1, x0, y0, width, values row by row); a tile is averaged where it is read, and only
cells of the preview are shuffled, at most `most` squared a band, whatever the raster's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import png

#: Colours of an outline and of its rim, and how training images are centred and scaled.
OUTLINE, RIM = (255, 230, 0), (0, 0, 0)
IMAGE_MEAN, IMAGE_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def preview_size(width: int, height: int, most: int) -> tuple[int, int]:
    scale = min(1.0, most / max(width, height))
    return max(1, round(width * scale)), max(1, round(height * scale))


def shares(first: int, many: int, whole: int, cells: int) -> tuple[int, np.ndarray]:
    """(first cell, matrix of cells and pixels): how much of each pixel, from `first` on, lies in each cell of an axis of `whole` pixels."""
    edge = np.arange(first, first + many + 1) * cells / whole
    low = int(edge[0])
    n = max(1, int(np.ceil(edge[-1] - 1e-9)) - low)
    cell = np.arange(low, low + n)[:, None]
    return low, np.clip(np.minimum(edge[1:], cell + 1) - np.maximum(edge[:-1], cell), 0, None)


def _averaged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    names = ["raster_id", "band", "width", "height", "y", "x", "total", "weight"]
    for batch in batches:
        for r in range(batch.num_rows):
            raster, band, x0, y0, tile_width, whole_width, whole_height, nodata = (batch.column(k)[r].as_py() for k in range(8))
            values = batch.column(8)[r]
            if None in (raster, band, x0, y0, tile_width, whole_width, whole_height) or not values.is_valid or not len(values.values):
                continue
            grid = values.values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, tile_width)
            known = np.isfinite(grid) if nodata is None else np.isfinite(grid) & (grid != nodata)
            width, height = preview_size(whole_width, whole_height, most)
            (cx, in_x), (cy, in_y) = shares(x0, tile_width, whole_width, width), shares(y0, len(grid), whole_height, height)
            total, weight = in_y @ np.where(known, grid, 0.0) @ in_x.T, in_y @ known @ in_x.T
            y, x = np.nonzero(weight > 1e-12)
            fixed = [pa.array(np.full(len(y), v)) for v in (raster, band, width, height)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(cy + y), pa.array(cx + x), pa.array(total[y, x]), pa.array(weight[y, x])], names)


def preview_cells(tiles: DataFrame, rasters: DataFrame, most: int = 2048) -> DataFrame:
    """(raster_id, band, width, height, y, x, value): the preview's cells, means of what each covers; cells without known values are absent.

    rasters: raster_id, width, height, nodata. Null and non-finite values and those that equal nodata don't count.
    """
    sized = tiles.join(rasters.select("raster_id", F.col("width").alias("whole_width"), F.col("height").alias("whole_height"), F.col("nodata").cast("double")), "raster_id")
    rows = sized.select(*(F.col(c).cast("long") for c in ("raster_id", "band", "x0", "y0", "width", "whole_width", "whole_height")), "nodata", F.col("values").cast("array<double>"))
    parts = rows.mapInArrow(lambda batches: _averaged(batches, most), "raster_id long, band long, width long, height long, y long, x long, total double, weight double")
    return parts.groupBy("raster_id", "band", "width", "height", "y", "x").agg((F.sum("total") / F.sum("weight")).alias("value"))


def display_levels(cells: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Cells with `level` 0 to 255 between two percentiles of their band; a flat band has a range of 1."""
    edges = cells.groupBy("raster_id", "band").agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("edges"))
    least, most = F.col("edges")[0], F.when(F.col("edges")[1] > F.col("edges")[0], F.col("edges")[1]).otherwise(F.col("edges")[0] + 1)
    stretched = (F.col("value") - least) * 255.0 / (most - least)
    return cells.join(edges, ["raster_id", "band"]).withColumn("level", F.greatest(F.least(stretched, F.lit(255.0)), F.lit(0.0)).cast("int")).drop("edges")


def _lines_of(cells: DataFrame) -> DataFrame:
    """A row a line of a band: (raster_id, width, height, y, band, xs, levels)."""
    listed = F.array_sort(F.collect_list(F.struct("x", "level")))
    lines = cells.filter("band <= 3").groupBy("raster_id", "width", "height", "y", "band").agg(listed.alias("c"))
    return lines.select("raster_id", "width", "height", "y", "band", F.col("c.x").alias("xs"), F.col("c.level").alias("levels"))


def _assembled(key: tuple, lines: pa.Table, paint: pa.Table | None) -> pa.Table:
    if not lines.num_rows:
        return pa.table({"raster_id": pa.array([], pa.int64()), "width": pa.array([], pa.int64()), "height": pa.array([], pa.int64()), "png": pa.array([], pa.binary())})
    width, height = lines.column("width")[0].as_py(), lines.column("height")[0].as_py()
    bands = sorted(set(lines.column("band").to_pylist()))
    image = np.zeros((height, width, 3), np.uint8)
    for y, band, xs, levels in zip(lines.column("y").to_pylist(), lines.column("band").to_pylist(), lines.column("xs"), lines.column("levels")):
        image[y, xs.values.to_numpy(), bands.index(band)] = levels.values.to_numpy()
    for c in range(len(bands), 3):  # missing channels repeat the last one
        image[:, :, c] = image[:, :, len(bands) - 1]
    if paint is not None and paint.num_rows:
        for _, y, first, end, colour in sorted(zip(*(paint.column(c).to_pylist() for c in ("rank", "y", "first", "end", "colour")))):
            if 0 <= y < height:
                image[y, max(first, 0) : max(end, 0)] = [colour >> 16, colour >> 8 & 255, colour & 255]
    return pa.table({"raster_id": pa.array([key[0].as_py()], pa.int64()), "width": pa.array([width], pa.int64()), "height": pa.array([height], pa.int64()), "png": pa.array([png.encode(image)], pa.binary())})


_PICTURE = "raster_id long, width long, height long, png binary"


def previews(tiles: DataFrame, rasters: DataFrame, most: int = 2048) -> DataFrame:
    """(raster_id, width, height, png): the first three bands, stretched to 8 bits; a picture is one row, its lines meet in one task."""
    return _lines_of(display_levels(preview_cells(tiles, rasters, most))).groupBy("raster_id").applyInArrow(lambda key, lines: _assembled(key, lines, None), _PICTURE)


def spans_inside(rings: list[np.ndarray], height: int) -> list[tuple[int, int, int]]:
    """(y, first, end) of the pixels whose centres an odd number of the rings go round, line by line."""
    if not rings:
        return []
    e = np.concatenate([np.column_stack([r[:-1], r[1:]]) for r in rings])
    out = []
    low, high = max(0, int(np.floor(e[:, [1, 3]].min()))), min(height, int(np.ceil(e[:, [1, 3]].max())))
    for y in range(low, high):
        at = y + 0.5
        cut = e[(e[:, 1] <= at) != (e[:, 3] <= at)]
        x = np.sort(cut[:, 0] + (at - cut[:, 1]) * (cut[:, 2] - cut[:, 0]) / (cut[:, 3] - cut[:, 1]))
        first, end = np.ceil(x[0::2] - 0.5).astype(int), np.ceil(x[1::2] - 0.5).astype(int)
        out += [(y, a, b) for a, b in zip(first.tolist(), end.tolist()) if b > a]
    return out


def spans_along(rings: list[np.ndarray], thick: float, height: int) -> list[tuple[int, int, int]]:
    """(y, first, end) of the pixels whose centres are at most half of `thick` away from an edge, line by line."""
    out, far = [], thick / 2
    for ring in rings:
        for a, b in zip(ring[:-1], ring[1:]):
            d, long = b - a, float(np.hypot(*(b - a)))
            for y in range(max(0, int(np.floor(min(a[1], b[1]) - far))), min(height, int(np.ceil(max(a[1], b[1]) + far)) + 1)):
                x = np.arange(int(np.floor(min(a[0], b[0]) - far)), int(np.ceil(max(a[0], b[0]) + far)) + 1)
                v = np.column_stack([x + 0.5 - a[0], np.full(len(x), y + 0.5 - a[1])])
                t = np.clip(v @ d / long**2, 0, 1) if long else np.zeros(len(x))
                near = np.flatnonzero(((v - t[:, None] * d) ** 2).sum(1) <= far**2)
                if len(near):  # what is near a segment is one run a line
                    out.append((y, int(x[near[0]]), int(x[near[-1]]) + 1))
    return out


def _painted(batches: Iterator[pa.RecordBatch], colour: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raster, number, width, height, parts in zip(*(batch.column(k).to_pylist() for k in range(5))):
            rings = [np.array([(p["x"], p["y"]) for p in ring], float) for polygon in parts or [] for ring in polygon if ring and len(ring) > 1]
            line = max(2, min(width, height) // 300)
            if colour is not None:
                rows += [(raster, 3 * number, *span, colour) for span in spans_inside(rings, height)]
            for k, (thick, (r, g, b)) in enumerate(((line + 2, RIM), (line, OUTLINE)), 1):
                rows += [(raster, 3 * number + k, *span, r << 16 | g << 8 | b) for span in spans_along(rings, thick, height)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)], ["raster_id", "rank", "y", "first", "end", "colour"])


def overlays(tiles: DataFrame, rasters: DataFrame, features: DataFrame, most: int = 2048, fill: tuple[int, int, int] | None = None) -> DataFrame:
    """Previews with features' outlines (a rim, then the line) on them, and their insides where `fill` is a colour.

    features: raster_id, number (later ones lie on top), polygons in pixels of the raster. A raster without features is its preview.
    """
    lines = _lines_of(display_levels(preview_cells(tiles, rasters, most)))
    on = features.join(rasters.select("raster_id", "width", "height"), "raster_id")
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest("width", "height"))
    side = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) * scale)).cast("long")
    moved = F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct((v["x"] * side("width") / F.col("width")).alias("x"), (v["y"] * side("height") / F.col("height")).alias("y")))))
    shaped = on.select(F.col("raster_id").cast("long"), F.col("number").cast("long"), side("width").alias("w"), side("height").alias("h"), moved.alias("polygons"))
    colour = None if fill is None else fill[0] << 16 | fill[1] << 8 | fill[2]
    paint = shaped.mapInArrow(lambda batches: _painted(batches, colour), "raster_id long, rank long, y long, first long, end long, colour long")
    return lines.groupBy("raster_id").cogroup(paint.groupBy("raster_id")).applyInArrow(_assembled, _PICTURE)


def resize_weights(many: int, wanted: int) -> np.ndarray:
    """(wanted, many): what each pixel adds to each pixel of the resized axis, by a triangle as wide as the step where it shrinks."""
    step = many / wanted
    reach = max(step, 1.0)
    centre = (np.arange(wanted)[:, None] + 0.5) * step
    weight = np.clip(1 - np.abs(np.arange(many) + 0.5 - centre) / reach, 0, None)
    return weight / weight.sum(1, keepdims=True)


def training_samples(samples: DataFrame, size: int | None = None, augment: bool = False, seed: int = 0) -> DataFrame:
    """(sample_id, height, width, image, mask, turned): samples (sample_id, height, width, image: bytes of RGB, mask: bytes of grey) as arrays.

    With `augment` a sample is flipped left to right, up to down and turned by quarters as a hash of its id and the seed says, image and mask alike;
    `turned` (0 to 7) tells how. Resizing is bilinear for images, nearest for masks. Images are centred and scaled, channel by channel (channels
    first); masks are 1 where they are above 0. A sample whose bytes don't fit its size is an error there: image and mask are null.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sample_id, height, width, image, mask, turn in zip(*(c.to_pylist() for c in batch.columns)):
                if None in (height, width, image, mask) or len(image) != 3 * height * width or len(mask) != height * width:
                    out.append((sample_id, None, None, None, None, None))
                    continue
                rgb, grey = np.frombuffer(image, np.uint8).reshape(height, width, 3), np.frombuffer(mask, np.uint8).reshape(height, width)
                if turn & 4:
                    rgb, grey = rgb[:, ::-1], grey[:, ::-1]
                rgb, grey = np.rot90(rgb, turn & 3), np.rot90(grey, turn & 3)
                if size:
                    across, down = resize_weights(rgb.shape[1], size), resize_weights(rgb.shape[0], size)
                    rgb = np.rint(np.einsum("yh,hxc->yxc", down, np.rint(np.einsum("xw,hwc->hxc", across, rgb.astype(float)))))
                    near = [((np.arange(size) + 0.5) * n / size).astype(int) for n in grey.shape]
                    grey = grey[near[0]][:, near[1]]
                made = ((rgb / 255.0 - np.array(IMAGE_MEAN)) / np.array(IMAGE_STD)).transpose(2, 0, 1).astype(np.float32)
                out.append((sample_id, rgb.shape[0], rgb.shape[1], made.ravel(), (grey > 0).astype(np.int8).ravel(), turn))
            types = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.list_(pa.int8()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], ["sample_id", "height", "width", "image", "mask", "turned"])

    turn = F.pmod(F.xxhash64(F.col("sample_id").cast("string"), F.lit(seed)), F.lit(8)).cast("int") if augment else F.lit(0)
    rows = samples.select(F.col("sample_id").cast("string"), F.col("height").cast("int"), F.col("width").cast("int"), "image", "mask", turn.alias("turned"))
    return rows.mapInArrow(work, "sample_id string, height int, width int, image array<float>, mask array<tinyint>, turned int")


def prediction_records(masks: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(sample_id, mean_probability, predicted_fraction, mask_png): what is kept of predicted masks (sample_id, width, values)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for width, values in zip(batch.column(1).to_pylist(), batch.column(2)):
                if not width or not values.is_valid or not len(values.values):
                    files.append(None)
                    continue
                grid = values.values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                files.append(png.encode(np.where(grid >= threshold, 255, 0).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(files, pa.binary())], ["sample_id", "mean_probability", "predicted_fraction", "mask_png"])

    over = F.filter("values", lambda v: v >= threshold)
    mean = F.when(F.size(over) > 0, F.aggregate(over, F.lit(0.0), lambda a, v: a + v) / F.size(over)).otherwise(F.lit(0.0))
    rows = masks.select(F.col("sample_id").cast("string"), F.col("width").cast("int"), F.col("values").cast("array<double>").alias("values")).withColumn("mean", mean).withColumn("share", F.when(F.size("values") > 0, F.size(over) / F.size("values")))
    return rows.mapInArrow(work, "sample_id string, mean_probability double, predicted_fraction double, mask_png binary")
