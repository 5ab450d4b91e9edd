"""Scanned pages made ready for reading: contrast, median, rotation against the skew, threshold.

An image is rows (image_id, row, levels: array of 0 to 255), all of one length. Rotation maps each pixel of the result back to where it comes from.
Source and result are cut into blocks; a block of the result meets the blocks that its turned outline touches, a handful whatever the page's size,
so no task holds more than those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raster as R
from .graph import cut_lineage

BLOCK = 128
#: Pixels around a point that cubic interpolation looks at.
REACH = 2
PAPER = 255


def _cubic(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Between the second and third of four values along the first axis, at t."""
    a, b, c, d = v
    return b + t * (c - a + t * (2 * (a - b) + c - d + t * (b - a + d - c)))


def resampled(pixels: np.ndarray, x: np.ndarray, y: np.ndarray, at: tuple[int, int], size: tuple[int, int]) -> np.ndarray:
    """Levels at places (x, y; pixel centres are at halves) of an image of size (width, height), of which `pixels` is the part from `at` (x, y) on.

    Beyond the image is paper; near its edges the edge repeats.
    """
    width, height = size
    inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
    fx, fy = np.floor(x - 0.5).astype(int), np.floor(y - 0.5).astype(int)
    tx, ty = x - 0.5 - fx, y - 0.5 - fy
    column = [np.clip(np.clip(fx + k, 0, width - 1) - at[0], 0, pixels.shape[1] - 1) for k in range(-1, 3)]
    row = [np.clip(np.clip(fy + k, 0, height - 1) - at[1], 0, pixels.shape[0] - 1) for k in range(-1, 3)]
    lines = [_cubic(np.stack([pixels[r, c] for c in column]).astype(float), tx) for r in row]
    level = np.clip(np.floor(_cubic(np.stack(lines), ty) + 0.5), 0, 255)
    return np.where(inside, level, PAPER).astype(np.int32)


def source_of(x: np.ndarray | Column, y: np.ndarray | Column, degrees, width, height, of=np) -> tuple:
    """Where a pixel of an image turned anticlockwise by `degrees` about its middle comes from; y runs down."""
    angle = of.radians(degrees)
    u, v = x - width / 2, y - height / 2
    return of.cos(angle) * u - of.sin(angle) * v + width / 2, of.sin(angle) * u + of.cos(angle) * v + height / 2


def _turned_block(key: tuple, rows: pa.Table, block: int) -> pa.Table:
    image, ty, tx = (k.as_py() for k in key)
    width, height, degrees = (rows.column(c)[0].as_py() for c in ("width", "height", "degrees"))
    first = rows.column("first").to_numpy()
    line = rows.column("row").to_numpy()
    at = int(first.min()), int(line.min())
    parts = rows.column("part").combine_chunks()
    lengths = np.diff(parts.offsets.to_numpy())
    pixels = np.full((int(line.max()) - at[1] + 1, int((first + lengths).max()) - at[0]), PAPER, np.int32)
    for y, x, part in zip(line.tolist(), first.tolist(), parts):
        pixels[y - at[1], x - at[0] : x - at[0] + len(part)] = part.values.to_numpy()
    ys, xs = np.arange(ty * block, min((ty + 1) * block, height)), np.arange(tx * block, min((tx + 1) * block, width))
    x, y = source_of(*np.meshgrid(xs + 0.5, ys + 0.5), degrees, width, height)
    made = resampled(pixels, x, y, at, (width, height))
    return pa.table({"image_id": pa.array([image] * len(ys), rows.schema.field("image_id").type), "row": pa.array(ys, pa.int64()), "tx": pa.array(np.full(len(ys), tx), pa.int64()), "part": pa.array(list(made), pa.list_(pa.int32()))})


def rotated(images: DataFrame, angles: DataFrame, block: int = BLOCK) -> DataFrame:
    """Images turned anticlockwise by `degrees` of (image_id, degrees) about their middle, same size; null or missing degrees leave them as they are.

    Columns other than image_id, row and levels go. Images without pixels stay without.
    """
    rows = images.select("image_id", F.col("row").cast("long").alias("row"), F.col("levels").cast("array<int>").alias("levels"))
    sizes = rows.groupBy("image_id").agg(F.max(F.size("levels")).cast("long").alias("width"), (F.max("row") + 1).alias("height"))
    turning = angles.filter("degrees IS NOT NULL AND degrees <> 0").select("image_id", F.col("degrees").cast("double"))
    known = sizes.join(turning, "image_id").filter("width > 0")
    blocks = lambda c: F.sequence(F.lit(0).cast("long"), F.floor((F.col(c) - 1) / block).cast("long"))
    targets = known.select("*", F.explode(blocks("height")).alias("ty")).select("*", F.explode(blocks("width")).alias("tx"))
    # a block's turned outline, and the source blocks within its bounds
    edges = [(F.least((F.col(t) + k) * block, F.col(c)).cast("double") if k else (F.col(t) * block).cast("double")) for t, c in (("tx", "width"), ("ty", "height")) for k in (0, 1)]
    corners = [source_of(x, y, F.col("degrees"), F.col("width"), F.col("height"), F) for x in edges[:2] for y in edges[2:]]

    def reach(axis: int, most: str) -> Column:
        places = [c[axis] for c in corners]
        low, high = F.floor(F.least(*places)) - REACH, F.ceil(F.greatest(*places)) + REACH
        limit = lambda v: F.floor(F.least(F.greatest(v, F.lit(0)), F.col(most) - 1) / block).cast("long")
        return F.sequence(limit(low), limit(high))

    needed = targets.select("*", F.explode(reach(0, "width")).alias("sx")).select("*", F.explode(reach(1, "height")).alias("sy"))
    cut = rows.join(known.select("image_id"), "image_id", "left_semi").select("image_id", "row", "levels", F.floor(F.col("row") / block).alias("sy"), F.explode(F.sequence(F.lit(0), F.floor((F.size("levels") - 1) / block).cast("int"))).alias("k"))
    pieces = cut.select("image_id", "row", "sy", F.col("k").cast("long").alias("sx"), (F.col("k") * block).cast("long").alias("first"), F.slice("levels", F.col("k") * block + 1, F.lit(block)).alias("part"))
    met = needed.join(pieces, ["image_id", "sx", "sy"]).select("image_id", "ty", "tx", "width", "height", "degrees", "row", "first", "part")
    kind = images.schema["image_id"].dataType.simpleString()
    made = met.groupBy("image_id", "ty", "tx").applyInArrow(lambda key, part: _turned_block(key, part, block), f"image_id {kind}, row long, tx long, part array<int>")
    joined = made.groupBy("image_id", "row").agg(F.array_sort(F.collect_list(F.struct("tx", "part"))).alias("p")).select("image_id", "row", F.flatten(F.transform("p", lambda v: v["part"])).alias("levels"))
    return joined.unionByName(rows.join(known.select("image_id"), "image_id", "left_anti"))


def prepared(images: DataFrame, contrast: bool = True, denoise: bool = True, deskew: bool = True, threshold: bool = False, most: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """(images, (image_id, degrees)): the steps that are asked for, in this order, and the skew that was turned back (null where none was seen).

    Every step reads its images several times, so what a step has made is kept: otherwise all before it would be done anew for each reading.
    """
    given = out = cut_lineage(images.select("image_id", "row", "levels"))
    out = R.contrasted(out) if contrast else out
    out = R.smoothed(out) if denoise else out
    seen = given.select("image_id").distinct().withColumn("degrees", F.lit(None).cast("double"))
    if deskew:
        out = cut_lineage(out) if contrast or denoise else out
        seen = cut_lineage(R.skew(out, most))
        # rows run down: a positive skew falls to the right, and turning anticlockwise lifts it
        out = rotated(out, seen)
    return (R.two_levels(cut_lineage(out)) if threshold else out), seen
