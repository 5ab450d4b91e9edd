"""Shapes of several rings: with holes, of several parts, or crossing themselves.

A shape is (shape_id, rings): closed rings in any order and direction. A point is inside where an odd number of them go
round it, so holes and parts need no marks. Every shape is cut into convex pieces without common inside; areas,
overlaps and unions are those of the pieces, exact for any rings. Null and empty rings, or rings without area, have no pieces.

Where the geometry itself is wanted, shapes become polygons: outlines of their insides, and overlays of two shapes or of many, each a list of
outer rings with their holes (functions.overlay).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import overlay as O
from .cadastre import _common_cells, coverage
from .graph import cut_lineage, spread


def normalized(shapes: DataFrame) -> DataFrame:
    """Shapes with `pieces`, `area` (planar) and `status`: VALID, REPAIRED if rings cross or aren't closed polygons, EMPTY_GEOMETRY without area.

    A repaired shape's pieces cover the even-odd inside of its rings: a bow-tie is its two triangles, what two rings share is a hole.
    """
    cut = shapes.withColumn("pieces", G.pieces(F.col("rings")))
    area = F.aggregate("pieces", F.lit(0.0), lambda total, ring: total + G.planar_area(ring))
    status = F.when(F.size("pieces") == 0, "EMPTY_GEOMETRY").when(G.is_valid_shape(F.col("rings")), "VALID").otherwise("REPAIRED")
    return cut.withColumn("area", area).withColumn("status", status)


def pieces(shapes: DataFrame) -> DataFrame:
    """(shape_id, ring): a row a convex piece, which every operator on rings takes. Shapes are cut on all cores, and once however often pieces are read."""
    return cut_lineage(spread(shapes.select("shape_id", "rings")).select("shape_id", F.explode(G.pieces(F.col("rings"))).alias("ring")))


def overlaps(shapes: DataFrame, tolerance: float = 0.01, cell: float | None = None) -> DataFrame:
    """(left_id, right_id, area) of shapes whose insides share more than tolerance.

    Pieces meet on a grid, so shapes that are apart are never compared; a pair's area is the sum over its pieces.
    """
    boxed = pieces(shapes).select("shape_id", "ring", G.bounds(F.col("ring")).alias("b"))
    left = boxed.select(F.col("shape_id").alias("left_id"), F.col("ring").alias("lr"), F.col("b").alias("lb"))
    right = boxed.select(F.col("shape_id").alias("right_id"), F.col("ring").alias("rr"), F.col("b").alias("rb"))
    pairs = spread(_common_cells(left, right, cell).filter(F.col("left_id") < F.col("right_id")).select("left_id", "right_id", "lr", "rr"))
    met = pairs.select("left_id", "right_id", G.overlap_area(F.col("lr"), F.col("rr")).alias("area"))
    return met.groupBy("left_id", "right_id").agg(F.sum("area").alias("area")).filter(F.col("area") > tolerance)


def union_coverage(shapes: DataFrame, boundary: list[tuple[float, float]], cell: float | None = None) -> DataFrame:
    """One row: what the union of all shapes covers of a boundary ring, leaves open, and holds outside of it."""
    return coverage(pieces(shapes), boundary, cell)


def repaired(shapes: DataFrame) -> DataFrame:
    """Shapes with `polygons`, `area` (planar) and `status` as in `normalized`: rings that cross become the outlines of their inside.

    A polygon is its outer ring and then its holes; a shape without area has none.
    """
    made = shapes.withColumn("polygons", F.coalesce(O.outline(F.col("rings")), F.array().cast(O.POLYGONS)))
    status = F.when(F.size("polygons") == 0, "EMPTY_GEOMETRY").when(G.is_valid_shape(F.col("rings")), "VALID").otherwise("REPAIRED")
    return made.withColumn("area", O.polygons_area(F.col("polygons"))).withColumn("status", status)


def overlay(pairs: DataFrame, how: str, left: str = "left", right: str = "right") -> DataFrame:
    """Pairs of shapes (columns of rings) with `polygons` and `area` of their union, intersection, difference or symmetric_difference."""
    made = pairs.withColumn("polygons", O.overlay(how)(F.col(left), F.col(right)))
    return made.withColumn("area", O.polygons_area(F.col("polygons")))


def _bounds(rings: Column) -> Column:
    return G.bounds(F.flatten(rings))


def met(left: DataFrame, right: DataFrame, cell: float | None = None) -> DataFrame:
    """(left_id, right_id, left, right): rings of shapes (shape_id, rings) of two tables whose boxes overlap, each pair once.

    Ids and boxes alone go through the grid; rings join afterwards, and pairs are dealt over all cores. Ids are distinct within a table.
    """
    boxes = lambda rows, id_, b: rows.select(F.col("shape_id").alias(id_), _bounds(F.col("rings")).alias(b))
    pairs = _common_cells(boxes(left, "left_id", "lb"), boxes(right, "right_id", "rb"), cell).select("left_id", "right_id")
    pairs = pairs.join(left.select(F.col("shape_id").alias("left_id"), F.col("rings").alias("left")), "left_id")
    return spread(pairs.join(right.select(F.col("shape_id").alias("right_id"), F.col("rings").alias("right")), "right_id"))


def intersections(shapes: DataFrame, code: Column | None = None, tolerance: float = 0.01, cell: float | None = None) -> DataFrame:
    """(left_id, right_id, polygons, area) of shapes whose insides share more than tolerance, with what they share.

    The area is in square metres by the coordinate system's code, planar without one; a code without measures gives null areas, which stay.
    """
    pairs = met(shapes, shapes, cell).filter(F.col("left_id") < F.col("right_id"))
    found = pairs.select("left_id", "right_id", O.overlay("intersection")(F.col("left"), F.col("right")).alias("polygons")).filter(F.size("polygons") > 0)
    area = O.polygons_area(F.col("polygons")) if code is None else G.polygons_area_metres(F.col("polygons"), code)
    return found.withColumn("area", area).filter(F.col("area").isNull() | (F.col("area") > tolerance))


def topology(shapes: DataFrame, boundary: list[list[tuple[float, float]]] | None = None, tolerance: float = 0.01, cell: float | None = None) -> DataFrame:
    """(code, severity, shape_ids, area): issues of repaired shapes among each other and against a boundary of several rings.

    Only a shape without area is INVALID_GEOMETRY, all others are judged by their repaired insides: PARCEL_OVERLAP a pair,
    OUTSIDE_PROJECT_BOUNDARY a shape, and one COVERAGE_GAP without shapes for what the union leaves open of the boundary's outer ring
    (its first; holes of the boundary are no gaps).
    """
    ids = shapes.schema["shape_id"].dataType.simpleString()
    judged = cut_lineage(repaired(spread(shapes.select("shape_id", "rings"))).select("shape_id", O.all_rings(F.col("polygons")).alias("rings"), "status"))
    issue = lambda rows, code, severity, who, area: rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), who.cast(f"array<{ids}>").alias("shape_ids"), area.cast("double").alias("area"))
    fine = judged.filter("status <> 'EMPTY_GEOMETRY'").drop("status")
    out = issue(judged.filter("status = 'EMPTY_GEOMETRY'"), "INVALID_GEOMETRY", "ERROR", F.array("shape_id"), F.lit(None))
    out = out.unionByName(issue(intersections(fine, tolerance=tolerance, cell=cell), "PARCEL_OVERLAP", "REVIEW", F.array("left_id", "right_id"), F.col("area")))
    if boundary is None:
        return out
    edge = F.array(*(F.array(*(G.point(F.lit(float(x)), F.lit(float(y))) for x, y in ring)) for ring in boundary))
    leaves = fine.select("shape_id", O.polygons_area(O.overlay("difference")(F.col("rings"), edge)).alias("area")).filter(F.col("area") > tolerance)
    holes = F.array(*(F.array(*(G.point(F.lit(float(x)), F.lit(float(y))) for x, y in ring)) for ring in boundary[1:])) if len(boundary) > 1 else None
    covering = fine if holes is None else fine.unionByName(shapes.sparkSession.range(1).select(F.lit(None).cast(ids).alias("shape_id"), holes.alias("rings")))
    gap = union_coverage(covering, boundary[0], cell).filter(F.col("gap_m2") > tolerance)
    out = out.unionByName(issue(leaves, "OUTSIDE_PROJECT_BOUNDARY", "REVIEW", F.array("shape_id"), F.col("area")))
    return out.unionByName(issue(gap, "COVERAGE_GAP", "REVIEW", F.array(), F.col("gap_m2")))


def simplify_layer(shapes: DataFrame, tolerance: float) -> DataFrame:
    """Shapes (shape_id, polygons) with `polygons` of fewer points: no point moves, what goes lay within the tolerance of what stays.

    Points where three or more edges of the layer meet stay, and a border that two shapes share is thinned the same way for both, so
    neighbours still fit. A shape whose edges would cross is thinned less, alone. Ids are distinct; points join by their exact coordinates.
    """
    rings = shapes.select("shape_id", F.explode(O.all_rings(F.col("polygons"))).alias("r"))
    ends = rings.select("shape_id", F.explode(F.arrays_zip(F.slice("r", 1, F.size("r") - 1).alias("p"), F.slice("r", 2, F.size("r") - 1).alias("q"))).alias("e")).select("shape_id", "e.p", "e.q")
    both = ends.select("p", "q").unionByName(ends.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    junctions = both.groupBy("p").count().filter("count > 2").select("p")
    fixed = ends.select("shape_id", "p").distinct().join(junctions, "p").groupBy("shape_id").agg(F.collect_list("p").alias("_fixed"))
    return shapes.join(fixed, "shape_id", "left").withColumn("polygons", O.simplified(tolerance)(F.col("polygons"), F.col("_fixed"))).drop("_fixed")
