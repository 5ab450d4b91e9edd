"""Vectorisation of masks that are cut into tiles: components and their outlines across seams, whatever the tiling.

1. A task labels its tiles, row by row as runs of set pixels: runs of neighbouring rows that touch, also at corners, are one local component. It
   is named by its first pixel. A tile gives its components' sums, its set border pixels, and the edges of what is set.
2. Border pixels of different tiles that touch link local components; connected components of the links are the mask's own, named by their
   first pixels in reading order.
3. Sums add up; edges on seams that both sides have cancel; a component's edges are linked to polygons with holes.

So no task sees more than a tile of pixels, a row is a component, a border pixel or an edge, and the result doesn't depend on how a raster was cut.
Only a component's outline is one row, as it is in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import overlay as O
from .graph import components, cut_lineage

_SCHEMA = "raster_id long, kind string, node long, pixels long, total double, x long, y long, xa long, ya long, xb long, yb long, open boolean"
_FIELDS = [("raster_id", pa.int64()), ("kind", pa.string()), ("node", pa.int64()), ("pixels", pa.int64()), ("total", pa.float64()), *((c, pa.int64()) for c in ("x", "y", "xa", "ya", "xb", "yb")), ("open", pa.bool_())]

#: Rows that small tiles are gathered to before they leave a task.
_BATCH = 20_000


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end) of the runs of set pixels, in reading order."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1]


def label_runs(row: np.ndarray, first: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The first run of each run's 8-connected component."""
    at = row * (width + 2)
    low = np.searchsorted(at + end, at + width + 2 + first)
    many = np.maximum(np.searchsorted(at + first, at + width + 2 + end, side="right") - low, 0)
    one = np.repeat(np.arange(len(row)), many)
    other = np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many) + low[one]
    label = np.arange(len(row))
    while True:
        least = np.minimum(label[one], label[other])
        new = label.copy()
        # the runs' roots take the smaller label too, so that whole components meet
        for ends in (one, other, label[one], label[other]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _segments(side: np.ndarray, merge: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, first, end) of marked unit sides along rows, as runs or one by one."""
    if merge:
        return runs_of(side)
    line, first = np.nonzero(side)
    return line, first, first + 1


def _tile(values: np.ndarray, x0: int, y0: int, threshold: float) -> list[dict[str, np.ndarray | str]]:
    """What one tile gives: components, border pixels, edges."""
    mask = values >= threshold
    height, width = mask.shape
    row, first, end = runs_of(mask)
    if not len(row):
        return []
    label = label_runs(row, first, end, width)
    node = (y0 + row) * (1 << 32) + x0 + first
    sums = np.concatenate([[0.0], np.cumsum(np.where(mask, values, 0.0).ravel())])
    n = np.bincount(label, end - first, len(row)).astype(np.int64)
    total = np.bincount(label, sums[row * width + end] - sums[row * width + first], len(row))
    roots = np.flatnonzero(label == np.arange(len(row)))
    out: list[dict] = [{"kind": "component", "node": node[roots], "pixels": n[roots], "total": total[roots]}]
    image = np.zeros(height * width, np.int64)
    long = end - first
    image[np.repeat(row * width + first, long) + np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)] = np.repeat(node[label], long)
    image = image.reshape(height, width)
    border = np.zeros_like(mask)
    border[[0, -1]] = border[:, [0, -1]] = True
    y, x = np.nonzero(mask & border)
    out.append({"kind": "border", "node": image[y, x], "x": x0 + x, "y": y0 + y})
    padded = np.pad(mask, 1)
    for upright in (False, True):
        m, names, p = (mask.T, image.T, padded.T) if upright else (mask, image, padded)
        for far, beyond in ((0, p[:-2, 1:-1]), (1, p[2:, 1:-1])):
            free = m & ~beyond
            outer = np.zeros_like(free)
            outer[-1 if far else 0] = True
            for open_ in (False, True):
                line, a, b = _segments(free & (outer if open_ else ~outer), not open_)
                who, level = names[line, a], line + far
                if bool(far) != upright:  # interior on the left
                    a, b = b, a
                xa, ya, xb, yb = (level, a, level, b) if upright else (a, level, b, level)
                out.append({"kind": "edge", "node": who, "xa": x0 + xa, "ya": y0 + ya, "xb": x0 + xb, "yb": y0 + yb, "open": np.full(len(who), open_)})
    return out


def _read(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    held, count = [], 0
    for batch in batches:
        for r in range(batch.num_rows):
            raster, x0, y0, width = (batch.column(k)[r].as_py() for k in range(4))
            values = batch.column(4)[r]
            if raster is None or not values.is_valid or not width or not len(values.values):
                continue
            grid = values.values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            for part in _tile(np.nan_to_num(grid, nan=-np.inf), x0, y0, threshold):
                rows = len(part["node"])
                part |= {"raster_id": np.full(rows, raster), "kind": [part["kind"]] * rows}
                held.append(pa.RecordBatch.from_arrays([pa.array(part[c], t) if c in part else pa.nulls(rows, t) for c, t in _FIELDS], [c for c, _ in _FIELDS]))
                count += rows
            if count >= _BATCH:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, count = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def vectorize(tiles: DataFrame, threshold: float = 0.5, min_pixels: int = 1) -> DataFrame:
    """(raster_id, component, pixels, confidence, polygons) of the 8-connected components of values >= threshold.

    tiles: raster_id, x0, y0 (a tile's first pixel, not negative), width, values (row by row); tiles of a raster don't overlap. component is the
    number of the first pixel in reading order (y * 2**32 + x), confidence the mean value, polygons run along pixel edges, holes
    included; pixels that touch at corners only are polygons of one component. Null or empty tiles, null and non-numeric values are not set.
    """
    rows = tiles.select(*(F.col(c).cast("long") for c in ("raster_id", "x0", "y0", "width")), F.col("values").cast("array<double>"))
    seen = cut_lineage(rows.mapInArrow(lambda batches: _read(batches, threshold), _SCHEMA))
    border = seen.filter("kind = 'border'").select("raster_id", "x", "y", "node")
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))))
    beside = border.select("raster_id", F.col("node").alias("other"), F.explode(steps).alias("s"), "x", "y").select("raster_id", "other", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    links = border.join(beside, ["raster_id", "x", "y"]).filter("node <> other").select("raster_id", "node", "other")
    whole = components(links, "raster_id", "node", "other")

    def named(part: DataFrame) -> DataFrame:
        return part.join(whole, ["raster_id", "node"], "left").withColumn("component", F.coalesce("component", "node"))

    sums = named(seen.filter("kind = 'component'").select("raster_id", "node", "pixels", "total")).groupBy("raster_id", "component").agg(F.sum("pixels").alias("pixels"), F.sum("total").alias("total"))
    edges = seen.filter("kind = 'edge'").select("raster_id", "node", "xa", "ya", "xb", "yb", "open")
    # both sides of a seam have an edge between two set pixels, in opposite directions
    end = lambda side: F.struct(F.col(f"x{side}").alias("x"), F.col(f"y{side}").alias("y"))
    ends = F.array_sort(F.array(end("a"), end("b")))
    seams = edges.filter("open").withColumn("ends", ends).groupBy("raster_id", "ends").agg(F.count("*").alias("sides"), *(F.first(c).alias(c) for c in ("node", "xa", "ya", "xb", "yb"))).filter("sides = 1")
    kept = named(edges.filter("NOT open").drop("open").unionByName(seams.select("raster_id", "node", "xa", "ya", "xb", "yb")))
    outlines = kept.groupBy("raster_id", "component").agg(F.collect_list(F.struct("xa", "ya", "xb", "yb")).alias("edges"))
    found = sums.filter(F.col("pixels") >= min_pixels).join(outlines, ["raster_id", "component"])
    return found.select("raster_id", "component", "pixels", (F.col("total") / F.col("pixels")).alias("confidence"), O.of_edges(F.col("edges")).alias("polygons"))
