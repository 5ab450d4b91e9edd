"""Roads, land use and buildings as draft features: judged row by row, measured where the system is known, never repaired.

A geometry is `kind` (its GeoJSON type) and `parts`: the lines of linework or the outer rings of polygons. Rows that can't be
a feature keep their place with a `refusal`. Measures need a declared coordinate system; pixels and local units have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.sinks import geojson_feature
from .cadastre import feature_space

#: Where features come from and what they may be.
SOURCES = ("EXISTING_GIS", "MANUAL_DRAWN", "AI_CANDIDATE")
ROAD_CLASSES = ("ROAD", "PATHWAY", "ACCESS_CORRIDOR")
LAND_USE_CLASSES = ("RESIDENTIAL", "COMMERCIAL", "INDUSTRIAL", "AGRICULTURAL", "VACANT", "ROAD_TRANSPORT", "WATERBODY", "GREEN_OPEN_SPACE", "UNKNOWN")
LINES, POLYGONS = ("LineString", "MultiLineString"), ("Polygon", "MultiPolygon")


def _declared(kind: str, classes: tuple[str, ...]) -> Column:
    """The refusals that roads and land use share."""
    empty = F.coalesce(F.size("parts"), F.lit(0)) == 0
    return F.when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "UNKNOWN_SOURCE").when(~F.coalesce(F.col(kind).isin(*classes), F.lit(False)), "UNKNOWN_CLASS").when(empty, "EMPTY_GEOMETRY")


def _draft(judged: DataFrame, kind: str, *more: Column) -> DataFrame:
    """Judged rows with the statuses of a draft; all null where a refusal stands."""
    fine = F.col("refusal").isNull()
    space = feature_space(F.col("source_crs"), F.col("coordinate_space"))
    return judged.select(
        "feature_id", "source", kind, "refusal", F.when(fine, space).alias("coordinate_space"), F.when(fine, "DRAFT").alias("status"), F.when(fine, "UNVERIFIED").alias("verification_status"),
        F.when(fine & (F.col("source") == "AI_CANDIDATE"), "AI_PRELIMINARY").alias("ai_status"), *more, "parts",
    )


def roads(rows: DataFrame, allow_multiline: bool = False) -> DataFrame:
    """Draft roads, pathways and corridors.

    Input: feature_id, source, road_class, kind, parts, road_surface (whether a polygon is declared a surface), source_crs,
    coordinate_space. Adds geometry_kind (LINE or SURFACE) and length_m: along lines, around surfaces. Lines need two
    distinct points each, surfaces valid rings.
    """
    line, polygon = F.col("kind").isin(*LINES), F.col("kind").isin(*POLYGONS)
    short = F.exists("parts", lambda p: F.size(F.array_distinct(p)) < 2)
    surface = polygon & F.coalesce("road_surface", F.lit(False))
    refusal = _declared("road_class", ROAD_CLASSES)
    refusal = refusal.when((F.col("kind") == "MultiLineString") & F.lit(not allow_multiline), "MULTILINE_NOT_ALLOWED").when(line & short, "TOO_FEW_POINTS")
    refusal = refusal.when(surface & ~F.coalesce(G.are_valid_polygons(F.col("parts")), F.lit(False)), "INVALID_SURFACE").when(~F.coalesce(line | surface, F.lit(False)), "NOT_A_ROAD_GEOMETRY")
    length = F.when(F.col("refusal").isNull(), G.parts_length(F.col("parts"), G.crs_code(F.col("source_crs"))))
    return _draft(rows.withColumn("refusal", refusal), "road_class", F.when(F.col("refusal").isNull(), F.when(line, "LINE").otherwise("SURFACE")).alias("geometry_kind"), length.alias("length_m"))


def land_use(rows: DataFrame, allow_multipolygon: bool = False) -> DataFrame:
    """Draft land use, no legal class.

    Input: feature_id, source, land_use_class, kind, parts, source_crs, coordinate_space. Adds area_m2 and area_sqft, sums of parts.
    """
    refusal = _declared("land_use_class", LAND_USE_CLASSES)
    refusal = refusal.when((F.col("kind") == "MultiPolygon") & F.lit(not allow_multipolygon), "MULTIPOLYGON_NOT_ALLOWED").when(~F.coalesce(F.col("kind").isin(*POLYGONS), F.lit(False)), "NOT_A_POLYGON")
    refusal = refusal.when(~F.coalesce(G.are_valid_polygons(F.col("parts")), F.lit(False)), "INVALID_POLYGON")
    area = F.when(F.col("refusal").isNull(), G.parts_area(F.col("parts"), G.crs_code(F.col("source_crs"))))
    out = _draft(rows.withColumn("refusal", refusal), "land_use_class", area.alias("area_m2"))
    return out.withColumn("area_sqft", G.square_feet(F.col("area_m2")))


def buildings(components: DataFrame, transform: tuple[float, ...] | None = None, crs: str | None = None, min_area: float = 0.0, confidence: float | None = None) -> DataFrame:
    """Preliminary buildings from mask components (mask_id, component, pixels, confidence, ring in pixels).

    With a transform (a, b, c, d, e, f) and a coordinate system, rings go to the world and areas are square metres; otherwise both
    stay in pixels, without measures. min_area is in square metres or pixels accordingly; a world of unknown measures is judged
    in its own units. Holes count through `pixels`: the area inside the outer ring is scaled by the share of pixels set.
    `confidence` stands where a component has none.
    """
    world = transform is not None and crs is not None
    rows = components.select("mask_id", "component", "pixels", F.coalesce("confidence", F.lit(confidence).cast("double")).alias("confidence"), "ring")
    share = F.col("pixels") / G.planar_area(F.col("ring"))
    if world:
        t = F.struct(*(F.lit(float(v)).alias(n) for n, v in zip("abcdef", transform)))
        code = G.crs_code(F.lit(crs))
        rows = rows.withColumn("_share", share).withColumn("ring", F.transform("ring", lambda p: G.affine_point(t, p["x"], p["y"])))
        rows = rows.withColumn("area_m2", G.area_square_metres(F.col("ring"), code) * F.col("_share"))
        kept = rows.filter(F.coalesce("area_m2", G.planar_area(F.col("ring")) * F.col("_share")) >= min_area).drop("_share")
    else:
        kept = rows.filter(F.col("pixels") >= min_area).withColumn("area_m2", F.lit(None).cast("double"))
    return kept.select(
        "mask_id", "component", "confidence", "area_m2", G.square_feet(F.col("area_m2")).alias("area_sqft"), F.lit("WORLD" if world else "PIXEL").alias("coordinate_space"),
        F.lit(crs if world else None).cast("string").alias("source_crs"), F.lit("AI_PRELIMINARY").alias("status"), F.lit("UNVERIFIED").alias("verification_status"), "ring",
    )


def geojson(features: DataFrame, identifier: Column, ring: str, properties: list[str]) -> DataFrame:
    """One GeoJSON line a feature with a ring."""
    return features.select(geojson_feature(F.col(ring), F.struct(*properties), identifier).alias("value")).filter("value IS NOT NULL")
