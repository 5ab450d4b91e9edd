"""Parcels: acquisition, topology, edits, tiles and masks.

Overlaps are found on a grid: a rectangle of cells around each parcel's box, joined cell by cell, each pair kept in one
cell only. Cells are sized from the parcels' own boxes, so a parcel covers few cells; no pair is made
that doesn't share a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.overlay import overlay
from ..functions.raster import components, outlines
from ..functions.scores import percent_change
from .graph import cut_lineage, spread

SOURCES = ("GNSS_SURVEY", "FMB_IMPORT", "CADASTRAL_IMPORT", "MANUAL_DRAWING", "AI_VISIBLE_BOUNDARY")
SPACES = ("PIXEL", "LOCAL", "UNKNOWN")
#: Severity of a topology issue as a validation issue.
TOPOLOGY_SEVERITY = {"ERROR": "HIGH", "REVIEW": "MEDIUM", "WARNING": "LOW", "INFO": "INFO"}


def acquire(rows: DataFrame) -> DataFrame:
    """Draft parcels from declared evidence: status, coordinate_space, requires_survey, area, and `refusal` where it can't be one.

    Input: parcel_id, source, source_crs, coordinate_space, confidence, evidence_type, ring (for GNSS: points, at least three
    distinct; the ring is closed here).
    """
    code = G.crs_code(F.col("source_crs"))
    gnss = F.col("source") == "GNSS_SURVEY"
    ring = F.when(gnss, G.close_ring(F.col("ring"))).otherwise(F.col("ring"))
    ai = F.col("source") == "AI_VISIBLE_BOUNDARY"
    nothing = ai & (F.col("evidence_type") == "NO_VISIBLE_EVIDENCE")
    space = F.when(F.col("source_crs").isNotNull(), "WORLD").otherwise(F.coalesce("coordinate_space", F.lit("LOCAL")))
    refusal = (
        F.when(~F.col("source").isin(*SOURCES), "UNKNOWN_SOURCE")
        .when(F.col("source_crs").isNull() & ~F.coalesce("coordinate_space", F.lit("LOCAL")).isin(*SPACES), "UNKNOWN_COORDINATE_SPACE")
        .when(F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1), "CONFIDENCE_RANGE")
        .when(ai & F.col("evidence_type").isNull(), "EVIDENCE_REQUIRED")
        .when(nothing, F.lit(None))
        .when(F.coalesce(G.distinct_points(ring), F.lit(0)) < 3, "TOO_FEW_POINTS")
    )
    judged = rows.withColumn("refusal", refusal).withColumn("ring", F.when(~F.coalesce(nothing, F.lit(False)), ring))
    fine = F.col("refusal").isNull()
    area = F.when(space == "WORLD", G.area_square_metres(F.col("ring"), code))
    return judged.select(
        "parcel_id", "source", "refusal", F.when(fine, space).alias("coordinate_space"), F.when(fine, F.when(nothing, "NOT_DETERMINED").otherwise("DRAFT")).alias("status"),
        F.when(fine, "UNVERIFIED").alias("verification_status"), F.when(fine, ai).alias("requires_survey"), F.when(fine & ai, "AI_PRELIMINARY").alias("ai_boundary_status"), "ring",
        F.when(fine, area).alias("area_m2"), F.when(fine, G.square_feet(area)).alias("area_sqft"),
    )


def feature_space(source_crs: Column, declared: Column) -> Column:
    """Coordinate space of roads and land use: an unknown declared one falls back to LOCAL (parcels refuse it)."""
    return F.when(source_crs.isNotNull(), "WORLD").when(declared.isin(*SPACES), declared).otherwise("LOCAL")


#: Rings that coverage takes in one cell before it is cut.
CELL_RINGS = 256
#: Masks whose features leave a task at once, however many Arrow hands over.
MASKS = 256
#: Levels of the grid: cells have sides of 2**level; larger boxes take several cells of the last.
LEVELS = (-40, 60)


def _common_cells(left: DataFrame, right: DataFrame, cell: float | None = None) -> DataFrame:
    """Rows of left (lr, lb, ...) and right (rr, rb, ...) whose boxes overlap, each pair once.

    A hierarchical grid: a box lies in the cells, four at most, of the level of its own size, and visits those that it touches on coarser
    levels that the other side has. A pair meets on the level of its larger box, so rows a box are bounded whatever sizes are mixed.
    `cell` is the least side of a cell; without it every box has the level of its size.
    """
    unit, (least, most) = cell or 1.0, (0 if cell else LEVELS[0], LEVELS[1])

    def level(b: str) -> Column:
        side = F.greatest(F.col(f"{b}.x1") - F.col(f"{b}.x0"), F.col(f"{b}.y1") - F.col(f"{b}.y0"))
        return F.coalesce(F.least(F.greatest(F.ceil(F.log2(F.when(side > 0, side / unit))), F.lit(least)), F.lit(most)), F.lit(least)).cast("int")

    def gridded(rows: DataFrame, b: str, levels: Column) -> DataFrame:
        side = F.pow(F.lit(2.0), F.col("lv")) * unit
        span = lambda c: F.floor(F.col(f"{b}.{c}") / side).cast("long")
        placed = rows.select("*", F.explode(levels).alias("lv"))
        return placed.select("*", F.explode(F.sequence(span("x0"), span("x1"))).alias("cx")).select("*", F.explode(F.sequence(span("y0"), span("y1"))).alias("cy"))

    left, right = (rows.withColumn(f"{b}_lv", level(b)).filter(F.col(f"{b}.x0").isNotNull()) for rows, b in ((left, "lb"), (right, "rb")))
    present = [sorted(x for x in (rows.agg(F.collect_set(f"{b}_lv")).first()[0])) for rows, b in ((left, "lb"), (right, "rb"))]  # a hundred numbers at most
    coarser = lambda b, there: F.filter(F.array(*map(F.lit, there)) if there else F.array().cast("array<int>"), lambda v: v > F.col(f"{b}_lv"))
    own = lambda b: F.array(f"{b}_lv")
    # the right box is the larger one or as large, or the left one is larger
    first = gridded(left, "lb", F.concat(own("lb"), coarser("lb", present[1]))).join(gridded(right, "rb", own("rb")), ["lv", "cx", "cy"])
    second = gridded(left, "lb", own("lb")).join(gridded(right, "rb", coarser("rb", present[0])), ["lv", "cx", "cy"]) if any(x > y for x in present[0] for y in present[1]) else None
    pairs = first if second is None else first.unionByName(second)
    low_x, low_y = F.greatest("lb.x0", "rb.x0"), F.greatest("lb.y0", "rb.y0")
    pairs = pairs.filter((low_x < F.least("lb.x1", "rb.x1")) & (low_y < F.least("lb.y1", "rb.y1")))
    # a pair that shares several cells stays in the one with the boxes' common lower corner
    side = F.pow(F.lit(2.0), F.col("lv")) * unit
    return pairs.filter((F.floor(low_x / side) == F.col("cx")) & (F.floor(low_y / side) == F.col("cy"))).drop("lv", "lb_lv", "rb_lv")


def _cell(boxes: DataFrame) -> float:
    """The side that nine of ten boxes don't exceed."""
    side = boxes.agg(F.percentile_approx(F.greatest(F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")), 0.9)).first()[0]
    return float(side) or 1.0 if side else 1.0


def overlaps(parcels: DataFrame, cell: float | None = None, area=None, tolerance: float = 0.01) -> DataFrame:
    """(left_id, right_id, area_m2) of parcels (parcel_id, ring) whose interiors overlap by more than tolerance.

    `area` makes square metres of the common part's polygons (planar by default); a null area counts as an overlap.
    """
    boxed = parcels.select("parcel_id", "ring", G.bounds(F.col("ring")).alias("b"))
    left = boxed.select(F.col("parcel_id").alias("left_id"), F.col("ring").alias("lr"), F.col("b").alias("lb"))
    right = boxed.select(F.col("parcel_id").alias("right_id"), F.col("ring").alias("rr"), F.col("b").alias("rb"))
    pairs = spread(_common_cells(left, right, cell).filter(F.col("left_id") < F.col("right_id")).select("left_id", "right_id", "lr", "rr"))
    if area is None:
        return pairs.withColumn("area_m2", G.overlap_area(F.col("lr"), F.col("rr"))).filter(F.col("area_m2") > tolerance).select("left_id", "right_id", "area_m2")
    common = pairs.select("left_id", "right_id", overlay("intersection")(F.array("lr"), F.array("rr")).alias("part")).filter(F.size("part") > 0)
    return common.select("left_id", "right_id", area(F.col("part")).alias("area_m2")).filter(F.col("area_m2").isNull() | (F.col("area_m2") > tolerance))


def topology_issues(parcels: DataFrame, boundary=None, tolerance: float = 0.01, cell: float | None = None) -> DataFrame:
    """(code, severity, parcel_ids, area_m2): invalid rings, overlaps among the valid ones, and against a boundary ring what leaves it or is left uncovered.

    `boundary` is a list of (x, y) of one valid closed ring; the gap is one row without parcels.
    """
    judged = cut_lineage(spread(parcels).withColumn("ok", G.is_valid_polygon(F.col("ring"))))
    fine = judged.filter("ok").drop("ok")
    issue = lambda rows, code, severity, ids, area: rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), ids.alias("parcel_ids"), area.cast("double").alias("area_m2"))
    one, nobody = F.array("parcel_id"), F.array().cast(f"array<{parcels.schema['parcel_id'].dataType.simpleString()}>")
    out = issue(judged.filter("NOT ok"), "INVALID_GEOMETRY", "ERROR", one, F.lit(None))
    out = out.unionByName(issue(overlaps(fine, cell, tolerance=tolerance), "PARCEL_OVERLAP", "REVIEW", F.array("left_id", "right_id"), F.col("area_m2")))
    if boundary is None:
        return out
    edge = F.array(*(G.point(F.lit(x), F.lit(y)) for x, y in boundary))
    leaves = fine.withColumn("area_m2", G.planar_area(F.col("ring")) - G.overlap_area(F.col("ring"), edge)).filter(F.col("area_m2") > tolerance)
    gap = coverage(fine, boundary, cell).filter(F.col("gap_m2") > tolerance)
    return out.unionByName(issue(leaves, "OUTSIDE_PROJECT_BOUNDARY", "REVIEW", one, F.col("area_m2"))).unionByName(issue(gap, "COVERAGE_GAP", "REVIEW", nobody, F.col("gap_m2")))


def issues_by_parcel(issues: DataFrame, parcel: str = "parcel_id", related: str = "related_parcel_id") -> DataFrame:
    """Issues once for each parcel that they concern, as the one or the other: the parcel is column `concerns`."""
    return issues.withColumn("concerns", F.explode(F.array_distinct(F.array_compact(F.array(parcel, related)))))


def coverage(parcels: DataFrame, boundary: list[tuple[float, float]], cell: float | None = None) -> DataFrame:
    """One row for valid rings (ring): their union's covered, gap and outside area against a boundary ring of (x, y).

    Rings go to all grid cells that their boxes touch, equal rings once; a cell's union is exact within it, and cells partition the
    plane, so sums are. Cells are sized from the parcels, wherever they lie, so a cell holds the parcels around one place; a cell
    of more than CELL_RINGS rings is cut into 4, 16, ... cells, as many as its rings call for.
    """
    boxed = parcels.select("ring", G.bounds(F.col("ring")).alias("b"))
    side = 4 * _cell(boxed) if cell is None else cell
    span = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")
    rows = boxed.select("ring", "b", F.explode(F.sequence(span("b.x0"), span("b.x1"))).alias("cx")).select("ring", "b", "cx", F.explode(F.sequence(span("b.y0"), span("b.y1"))).alias("cy")).distinct()
    counts = rows.groupBy("cx", "cy").count()
    finer = F.ceil(F.log2(F.col("count") / CELL_RINGS) / 2).cast("int")
    rows = rows.join(counts.select("cx", "cy", F.greatest(finer, F.lit(0)).alias("cut")), ["cx", "cy"])
    size = F.lit(side) / F.pow(F.lit(2.0), "cut")

    def parts(low: str, high: str, cell_: str) -> Column:
        """The finer cells of a cell that a box touches, numbered within the plane."""
        many = F.pow(F.lit(2.0), "cut").cast("long")
        first = F.col(cell_) * many
        return F.sequence(F.greatest(F.floor(F.col(low) / size).cast("long"), first), F.least(F.floor(F.col(high) / size).cast("long"), first + many - 1))

    rows = rows.select("ring", "b", "cut", "cy", F.explode(parts("b.x0", "b.x1", "cx")).alias("px")).select("ring", "cut", "px", F.explode(parts("b.y0", "b.y1", "cy")).alias("py"))
    mask = np.array(boundary, float)

    def measure(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        cut, cx, cy = (float(k) for k in key)
        side_ = side / 2.0**cut
        rings = [np.array([(p["x"], p["y"]) for p in r], float) for r in part["ring"]]
        union, inside = G.slab_areas(rings, (cx * side_, cy * side_, (cx + 1) * side_, (cy + 1) * side_), mask)
        return pd.DataFrame({"union": [union], "inside": [inside]})

    sums = rows.groupBy("cut", "px", "py").applyInPandas(measure, "union double, inside double").agg(F.coalesce(F.sum("union"), F.lit(0.0)).alias("union"), F.coalesce(F.sum("inside"), F.lit(0.0)).alias("inside"))
    whole = abs(float(np.sum(mask[:-1, 0] * mask[1:, 1] - mask[1:, 0] * mask[:-1, 1]))) / 2
    return sums.select(F.col("inside").alias("covered_m2"), (F.lit(whole) - F.col("inside")).alias("gap_m2"), (F.col("union") - F.col("inside")).alias("outside_m2"))


def edited(edits: DataFrame, limit_percent: float = 5.0) -> DataFrame:
    """Edits (parcel_id, ring before, ring after) with areas, change in percent, status and code.

    An invalid ring is INVALID; a change of more than the limit goes to review.
    """
    after = G.planar_area(F.col("after"))
    rated = edits.withColumn("ok", G.is_valid_polygon(F.col("after"))).withColumn("area_before", G.planar_area(F.col("before"))).withColumn("area_after", F.when(F.col("ok"), after))
    rated = rated.withColumn("change_percent", percent_change(F.col("area_before"), F.col("area_after")))
    large = F.abs("change_percent") > limit_percent
    return rated.withColumn("status", F.when(~F.col("ok"), "INVALID").when(large, "REVIEW_REQUIRED").otherwise("VALID")).withColumn(
        "code", F.when(~F.col("ok"), "INVALID_EDIT_GEOMETRY").when(large, "SIGNIFICANT_AREA_CHANGE")
    )


def edit_issues(edits: DataFrame, boundaries: DataFrame | None = None, neighbours: DataFrame | None = None, limit_percent: float = 5.0, tolerance: float = 0.01, cell: float | None = None) -> DataFrame:
    """(parcel_id, code, severity, neighbour_id, area_m2): every issue of every edit (parcel_id, project_id, ring before, ring after).

    `boundaries` (project_id, ring) are the projects' outlines; an edit whose project has none isn't judged by it. `neighbours`
    (parcel_id, ring) are met on a grid, a parcel never by its own edit. Invalid edits have no issue but that one. Rings of boundaries and neighbours
    must be valid.
    """
    rated = edited(edits, limit_percent)
    none = F.lit(None).cast(edits.schema["parcel_id"].dataType)
    change = F.when(F.col("code") == "SIGNIFICANT_AREA_CHANGE", F.abs(F.col("area_after") - F.col("area_before")))
    out = rated.filter("code IS NOT NULL").select("parcel_id", "code", F.when(F.col("ok"), "REVIEW").otherwise("ERROR").alias("severity"), none.alias("neighbour_id"), change.alias("area_m2"))
    fine = rated.filter("ok")
    review = F.lit("REVIEW").alias("severity")
    if boundaries is not None:
        within = fine.join(boundaries.select("project_id", F.col("ring").alias("_boundary")), "project_id")
        outside = within.withColumn("area_m2", F.col("area_after") - G.overlap_area(F.col("after"), F.col("_boundary"))).filter(F.col("area_m2") > tolerance)
        out = out.unionByName(outside.select("parcel_id", F.lit("OUTSIDE_PROJECT_BOUNDARY").alias("code"), review, none.alias("neighbour_id"), "area_m2"))
    if neighbours is not None:
        right = neighbours.select(F.col("parcel_id").alias("neighbour_id"), F.col("ring").alias("rr"), G.bounds(F.col("ring")).alias("rb"))
        left = fine.select("parcel_id", F.col("after").alias("lr"), G.bounds(F.col("after")).alias("lb"))
        met = _common_cells(left, right, cell).filter(F.col("parcel_id") != F.col("neighbour_id")).withColumn("area_m2", G.overlap_area(F.col("lr"), F.col("rr"))).filter(F.col("area_m2") > tolerance)
        out = out.unionByName(met.select("parcel_id", F.lit("NEIGHBOUR_OVERLAP").alias("code"), review, "neighbour_id", "area_m2"))
    return out


def compare(pairs: DataFrame) -> DataFrame:
    """Pairs (reference, candidate: valid rings of metres): areas, overlap, symmetric difference, change, Hausdorff distance.

    No overlap is null, not 0.
    """
    common = G.overlap_area(F.col("reference"), F.col("candidate"))
    out = pairs.withColumn("reference_area", G.planar_area(F.col("reference"))).withColumn("candidate_area", G.planar_area(F.col("candidate"))).withColumn("overlap_area", F.nullif(common, F.lit(0.0)))
    out = out.withColumn("symmetric_difference", F.col("reference_area") + F.col("candidate_area") - 2 * F.coalesce("overlap_area", F.lit(0.0)))
    return out.withColumn("change_percent", percent_change(F.col("reference_area"), F.col("candidate_area"))).withColumn("hausdorff", G.hausdorff(F.col("reference"), F.col("candidate")))


def unified_issues(issues: DataFrame) -> DataFrame:
    """One validation issue for each parcel of a topology issue; UNKNOWN where it names none."""
    severity = F.lit("LOW")
    for name, as_ in TOPOLOGY_SEVERITY.items():
        severity = F.when(F.upper("severity") == name, as_).otherwise(severity)
    ids = F.when(F.coalesce(F.size("parcel_ids"), F.lit(0)) > 0, F.col("parcel_ids").cast("array<string>")).otherwise(F.array(F.lit("UNKNOWN")))
    return issues.select("code", severity.alias("severity"), F.upper("severity").isin("ERROR", "REVIEW").alias("review_required"), F.concat(F.lit("GEOAI."), F.col("code")).alias("rule_id"), "area_m2", F.explode(ids).alias("entity_id"))


def tiles(rasters: DataFrame, size: int) -> DataFrame:
    """Tiles of rasters (raster_id, width, height, transform): offsets, sizes (smaller at the edges), child transform and corner bounds."""
    grid = rasters.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(size))).alias("row_offset")).select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(size))).alias("column_offset"))
    t = F.col("transform")
    width, height = F.least(F.lit(size), F.col("width") - F.col("column_offset")), F.least(F.lit(size), F.col("height") - F.col("row_offset"))
    corner = G.affine_point(t, F.col("column_offset"), F.col("row_offset"))
    far = G.affine_point(t, F.col("column_offset") + width, F.col("row_offset") + height)
    child = F.struct(t["a"].alias("a"), t["b"].alias("b"), corner["x"].alias("c"), t["d"].alias("d"), t["e"].alias("e"), corner["y"].alias("f"))
    name = F.format_string("%s_r%04d_c%04d.tif", F.col("raster_id").cast("string"), (F.col("row_offset") / size).cast("int"), (F.col("column_offset") / size).cast("int"))
    return grid.select(
        "raster_id", "row_offset", "column_offset", width.alias("tile_width"), height.alias("tile_height"), child.alias("transform"), name.alias("name"),
        F.least(corner["x"], far["x"]).alias("x0"), F.least(corner["y"], far["y"]).alias("y0"), F.greatest(corner["x"], far["x"]).alias("x1"), F.greatest(corner["y"], far["y"]).alias("y1"),
    )


def vectorize(masks: DataFrame, width: int, threshold: float = 0.5, min_area: float = 0.0) -> DataFrame:
    """Features of masks (mask_id, values: row-major probabilities): a row an 8-connected component of values >= threshold.

    Columns: mask_id, component, pixels, confidence (mean value), ring (outer, pixel edges), holes. A mask is one
    row, components never cross masks.
    """
    schema = f"mask_id long, component int, pixels int, confidence double, ring {G.RING}, holes int"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in (batch.iloc[at : at + MASKS] for batch in batches for at in range(0, len(batch), MASKS)):
            rows = []
            for mask_id, values in zip(some["mask_id"], some["values"]):
                if values is None or not len(values):
                    continue
                grid = np.asarray(values, float).reshape(-1, width)
                labels = components(grid >= threshold)
                for k in range(1, labels.max() + 1):
                    part = labels == k
                    if part.sum() < min_area:
                        continue
                    rings = outlines(part)
                    rows.append((mask_id, k, int(part.sum()), float(grid[part].mean()), [{"x": float(x), "y": float(y)} for x, y in rings[0]], len(rings) - 1))
            yield pd.DataFrame(rows, columns=["mask_id", "component", "pixels", "confidence", "ring", "holes"])

    return masks.select(F.col("mask_id").cast("long"), F.col("values").cast("array<double>")).mapInPandas(work, schema)
