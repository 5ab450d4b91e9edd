"""Raster functions: column expressions and aggregates over image or pixel rows; numpy on single masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-7
#: Fixed value: the threshold of an image of one level.
FLAT = 127
EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1)]


def otsu(histogram: DataFrame, *keys: str) -> DataFrame:
    """keys, threshold of histogram rows (keys, level, n): the level that parts each into two classes of largest variance between them.

    The first of equal levels counts; a histogram of one level has FLAT. A key has at most as many rows as levels, so running sums
    over a key are short; a level between two of the rows can't be better than the lower of them.
    """
    per = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = per.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mass = F.col("n").cast("double") * F.col("level")
    sums = histogram.filter("n > 0").select(*keys, "level", F.sum(F.col("n").cast("double")).over(upto).alias("w"), F.sum(mass).over(upto).alias("m"), F.sum(F.col("n").cast("double")).over(per).alias("all"), F.sum(mass).over(per).alias("all_m"))
    gap = F.col("all_m") * F.col("w") - F.col("m") * F.col("all")
    rated = sums.withColumn("v", F.when(F.col("all") > F.col("w"), gap * gap / (F.col("w") * (F.col("all") - F.col("w")))).otherwise(-1.0))
    best = F.max_by("level", F.struct("v", (-F.col("level")).alias("first")))
    return rated.groupBy(*keys).agg(F.when(F.count("*") == 1, F.lit(FLAT)).otherwise(best).cast("long").alias("threshold"))


def histogram(images: DataFrame) -> DataFrame:
    """image_id, level, n of images as rows (image_id, row, levels: array of 0 to 255)."""
    return images.select("image_id", F.explode("levels").alias("level")).groupBy("image_id", "level").agg(F.count("*").alias("n"))


def contrasted(images: DataFrame, factor: float = 1.5) -> DataFrame:
    """Images with every level's distance from the image's mean level (rounded) times factor, cut to 0 to 255."""
    middle = images.select("image_id", F.explode("levels").alias("v")).groupBy("image_id").agg(F.floor(F.avg("v") + 0.5).alias("_middle"))
    level = lambda v: F.least(F.greatest(F.floor(F.col("_middle") + factor * (v - F.col("_middle"))), F.lit(0)), F.lit(255)).cast("int")
    return images.join(middle, "image_id").withColumn("levels", F.transform("levels", level)).drop("_middle")


def smoothed(images: DataFrame) -> DataFrame:
    """Images with the median of each pixel's 3x3 neighbourhood; rows and columns beyond an edge repeat the edge.

    A row meets the rows above and below it by a window over its image; the nine values of a pixel are three slices.
    """
    order = Window.partitionBy("image_id").orderBy("row")
    near = images.withColumn("_up", F.coalesce(F.lag("levels").over(order), F.col("levels"))).withColumn("_down", F.coalesce(F.lead("levels").over(order), F.col("levels")))
    wide = lambda c: F.concat(F.slice(c, 1, 1), F.col(c), F.slice(c, -1, 1))
    near = near.select("*", *(wide(c).alias(f"_{k}") for k, c in enumerate(("_up", "levels", "_down"))))
    nine = lambda k: F.concat(*(F.slice(f"_{r}", k + 1, F.lit(3)) for r in range(3)))
    median = F.transform(F.sequence(F.lit(0), F.size("levels") - 1), lambda k: F.element_at(F.array_sort(nine(k)), 5))
    return near.withColumn("levels", F.when(F.size("levels") > 0, median).otherwise(F.col("levels"))).drop("_up", "_down", "_0", "_1", "_2")


def skew(images: DataFrame, most: float = 15.0, least: float = 0.15, pixels: int = 32) -> DataFrame:
    """image_id, degrees between the rows and the main axis of an image's dark pixels, to the nearer image axis.

    Dark is below the image's threshold. The axis comes from second moments, which are plain aggregates. Null where fewer than
    `pixels` are dark or the angle is out of range.
    """
    limits = otsu(histogram(images), "image_id")
    points = images.join(limits, "image_id").select("image_id", "threshold", "row", F.posexplode("levels").alias("column", "level")).filter("level < threshold")
    moments = points.groupBy("image_id").agg(F.count("*").alias("n"), F.var_pop("column").alias("xx"), F.var_pop("row").alias("yy"), F.covar_pop("column", "row").alias("xy"))
    axis = F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2)
    angle = axis - 90 * F.round(axis / 90)
    fine = (F.col("n") >= pixels) & F.abs(angle).between(least, most)
    return images.select("image_id").distinct().join(moments.select("image_id", F.when(fine, angle).alias("degrees")), "image_id", "left")


def two_levels(images: DataFrame) -> DataFrame:
    """Images with 255 above their threshold and 0 elsewhere."""
    limits = otsu(histogram(images), "image_id")
    return images.join(limits, "image_id").withColumn("levels", F.transform("levels", lambda v: F.when(v > F.col("threshold"), 255).otherwise(0))).drop("threshold")


def components(mask: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... of 8-connected components in row order; 0 is background."""
    height, width = mask.shape
    parent = np.arange(height * width)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for y, x in np.argwhere(mask):
        for dy, dx in EIGHT:
            v, u = y + dy, x + dx
            if 0 <= v and 0 <= u < width and mask[v, u]:
                a, b = root(y * width + x), root(v * width + u)
                parent[max(a, b)] = min(a, b)
    out, names = np.zeros((height, width), np.int32), {}
    for y, x in np.argwhere(mask):
        out[y, x] = names.setdefault(root(y * width + x), len(names) + 1)
    return out


def outlines(part: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed pixel-edge rings (x, y) of a component: the outer one, then its holes; straight runs are one edge.

    Pixels that touch at a corner only stay in one ring: there the walk turns towards the component.
    """
    height, width = part.shape
    filled = lambda y, x: 0 <= y < height and 0 <= x < width and bool(part[y, x])
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, x in np.argwhere(part):
        y, x = int(y), int(x)
        for inside, a, b in ((filled(y - 1, x), (x, y), (x + 1, y)), (filled(y, x + 1), (x + 1, y), (x + 1, y + 1)), (filled(y + 1, x), (x + 1, y + 1), (x, y + 1)), (filled(y, x - 1), (x, y + 1), (x, y))):
            if not inside:
                edges.setdefault(a, []).append(b)
    rings = []
    while edges:
        start = min(edges, key=lambda p: (p[1], p[0]))
        ring, at, way = [start], start, None
        while True:
            choices = edges[at]
            if len(choices) > 1 and way:
                left = (way[1], -way[0])  # keeps corner-joined pixels together
                choices.sort(key=lambda b: (b[0] - at[0], b[1] - at[1]) != left)
            to = choices.pop(0)
            if not choices:
                del edges[at]
            step = (to[0] - at[0], to[1] - at[1])
            if way == step:
                ring[-1] = to
            else:
                ring.append(to)
            way, at = step, to
            if at == start:
                break
        if len(ring) > 3 and (ring[1][0] - ring[0][0], ring[1][1] - ring[0][1]) == (0, 0):
            ring.pop(0)
        rings.append(ring)
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2
    return sorted(rings, key=lambda r: -area(r))


def stretch(value: Column, low: Column, high: Column, top: float = 1.0) -> Column:
    """Value between two percentiles as 0 to top; a flat band has its high one above its low."""
    end = F.when(high > low, high).otherwise(low + 1)
    return F.least(F.greatest((value - low) / (end - low), F.lit(0.0)), F.lit(1.0)) * top


#: Equal parts that a band's range is cut into for its percentiles.
RANGES = 4096


def percentiles(rows: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """(key, _p): a key's exact percentiles of its non-null values, interpolated between neighbours as `percentile` does it.

    Values are counted by RANGES equal parts of the key's range; only the parts that hold a rank are looked at value by value. So a key's values
    meet in no single task, unless nearly all of them lie in one of the parts. Keys are few (bands): what is known of each, a few rows, goes to every
    task, so rows stay where they are read and are never dealt by key.
    """
    known = rows.select(key, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    ends = known.groupBy(key).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("n"))
    part = F.when(F.col("most") > F.col("least"), F.least(F.floor((F.col("v") - F.col("least")) / (F.col("most") - F.col("least")) * RANGES), F.lit(RANGES - 1))).otherwise(0).alias("part")
    placed = known.join(F.broadcast(ends), key).select(key, "v", "n", part)
    counts = placed.groupBy(key, "n", "part").agg(F.count("*").alias("held"))
    before = counts.withColumn("before", F.sum("held").over(Window.partitionBy(key).orderBy("part")) - F.col("held"))
    # the two ranks that each share lies between
    place = lambda s: F.lit(s) * (F.col("n") - 1)
    ranks = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(up).alias("up"), (F.ceil(place(s)) if up else F.floor(place(s))).cast("long").alias("rank")) for k, s in enumerate(shares) for up in (False, True)))
    sought = before.select(key, "part", "before", "held", F.explode(ranks).alias("r")).filter((F.col("r.rank") >= F.col("before")) & (F.col("r.rank") < F.col("before") + F.col("held"))).select(key, "part", "before", "r.*")
    near = placed.join(F.broadcast(sought.select(key, "part").distinct()), [key, "part"], "left_semi").groupBy(key, "part", "v").agg(F.count("*").alias("held"))
    upto = near.withColumn("upto", F.sum("held").over(Window.partitionBy(key, "part").orderBy("v")))
    hit = sought.join(upto, [key, "part"]).filter((F.col("rank") < F.col("before") + F.col("upto")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("held")))
    found = hit.groupBy(key).agg(*(F.max(F.when((F.col("k") == k) & (F.col("up") == up), F.col("v"))).alias(f"_{k}{int(up)}") for k in range(len(shares)) for up in (False, True)))
    between = [(F.col(f"_{k}0") * (F.ceil(place(s)) - place(s)) + F.col(f"_{k}1") * (place(s) - F.floor(place(s)))) if s not in (0.0, 1.0) else F.col(f"_{k}0") for k, s in enumerate(shares)]
    whole = [F.when(F.floor(place(s)) == F.ceil(place(s)), F.col(f"_{k}0")).otherwise(b) for (k, s), b in zip(enumerate(shares), between)]
    return found.join(ends.select(key, "n"), key).select(key, F.array(*whole).alias("_p"))


def band_stretch(pixels: DataFrame, band: str, value: str, low: float = 0.02, high: float = 0.98, top: float = 1.0) -> DataFrame:
    """Pixels with their stretched value: exact percentiles of a band's valid (non-null) pixels; nodata becomes 0."""
    joined = pixels.join(F.broadcast(percentiles(pixels, band, value, [low, high])), band, "left")
    return joined.withColumn("stretched", F.coalesce(stretch(F.col(value), F.col("_p")[0], F.col("_p")[1], top), F.lit(0.0))).drop("_p")


def confusion(prediction: Column, truth: Column) -> list[Column]:
    """Counts of true positives, false positives and false negatives; null is negative."""
    p, t = F.coalesce(prediction, F.lit(False)), F.coalesce(truth, F.lit(False))
    return [F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn")]


def segmentation_scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """IoU, Dice, precision and recall of totals; nothing predicted and nothing there is perfect."""
    precision = F.when((tp + fp == 0) & (fn == 0), 1.0).otherwise(tp / (tp + fp + EPSILON))
    recall = F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn + EPSILON))
    empty = tp + fp + fn == 0
    return [
        F.when(empty, 1.0).otherwise(tp / (tp + fp + fn + EPSILON)).alias("iou"),
        F.when(empty, 1.0).otherwise(2 * tp / (2 * tp + fp + fn + EPSILON)).alias("dice"),
        precision.alias("precision"),
        recall.alias("recall"),
    ]


def mask_refusal(values: Column) -> Column:
    """Why a mask's values are no probabilities, null if they are: NO_VALUES, NON_FINITE, OUT_OF_RANGE (neither 0 to 1 nor 0 to 255) or NEGATIVE."""
    least, most = F.array_min(values), F.array_max(values)
    odd = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(values.isNull() | (F.size(values) == 0), "NO_VALUES").when(odd, "NON_FINITE").when((most > 1) & ((most > 255) | (least < 0)), "OUT_OF_RANGE").when(least < 0, "NEGATIVE")


def probabilities(values: Column) -> Column:
    """A mask's values from 0 to 1: those above 1 at most make it an 8-bit one, divided by 255. Null for a refused mask."""
    scale = F.when(F.array_max(values) > 1, 255.0).otherwise(1.0)
    return F.when(mask_refusal(values).isNull(), F.transform(values, lambda v: v.cast("double") / scale))
