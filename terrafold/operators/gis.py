"""GIS features of any geometry: GeoJSON payloads in, judged and measured, GeoJSON collections out.

Rows are (feature_id, source, payload, ...): a payload is a geometry, a feature or a collection of one, as text. What its properties say
(source_crs, coordinate_space, road_surface, confidence) counts unless a column of the row says otherwise. Polygons keep their holes and
parts; those that aren't valid are replaced by the outline of their inside. Rows that can't be a feature keep their place with a `refusal`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geojson as J
from ..functions import geometry as G
from ..functions import projections as P
from ..functions.overlay import outline
from .cadastre import feature_space
from .features import LAND_USE_CLASSES, ROAD_CLASSES, SOURCES

_SAID = "struct<source_crs:string,coordinate_space:string,road_surface:boolean,confidence:double,notes:array<string>,warnings:array<string>>"
#: Warnings that go with candidates from imagery.
ROAD_WARNING = "AI-derived road/pathway candidates require human GIS or survey verification."
LAND_USE_WARNING = "Imagery-derived land-use classification is preliminary and not a statutory or legal classification."


def declared(rows: DataFrame, expected: str, kind: str, classes: tuple[str, ...]) -> DataFrame:
    """Rows with geometry, refusal, and what the payload says (said)."""
    read = J.read(rows, "payload", expected).withColumn("said", F.from_json("properties", _SAID))
    refusal = F.when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "UNKNOWN_SOURCE").when(~F.coalesce(F.col(kind).isin(*classes), F.lit(False)), "UNKNOWN_CLASS").otherwise(F.col("unreadable"))
    said = lambda c: F.col(f"said.{c}") if c not in rows.columns else F.coalesce(c, f"said.{c}")
    read = read.withColumn("refusal", refusal).withColumn("source_crs", said("source_crs"))
    return read.withColumn("coordinate_space", feature_space(F.col("source_crs"), F.col("said.coordinate_space"))).drop("properties", "unreadable")


def _repaired(rows: DataFrame, where: Column) -> DataFrame:
    """Polygons that aren't valid become the outlines of their inside; `repaired` says so. Empty ones are refused."""
    rings = J.rings(F.col("geometry"))
    broken = where & F.col("refusal").isNull() & ~F.coalesce(G.is_valid_shape(F.when(where, rings)), F.lit(False))
    made = rows.withColumn("repaired", F.coalesce(broken, F.lit(False))).withColumn("_outline", outline(F.when(F.col("repaired"), rings)))
    made = made.withColumn("refusal", F.when(F.col("repaired") & (F.coalesce(F.size("_outline"), F.lit(0)) == 0), "INVALID_GEOMETRY").otherwise(F.col("refusal")))
    return made.withColumn("geometry", F.when(F.col("repaired"), J.of_polygons(F.col("_outline"))).otherwise(F.col("geometry"))).drop("_outline")


def _result(judged: DataFrame, feature_type: str, kind: str, warning: str, *more: Column) -> DataFrame:
    fine = F.col("refusal").isNull()
    ai = F.col("source") == "AI_CANDIDATE"
    warnings = F.concat(F.coalesce("said.warnings", F.array().cast("array<string>")), F.when(ai, F.array(F.lit(warning))).otherwise(F.array().cast("array<string>")))
    return judged.select(
        "feature_id", F.lit(feature_type).alias("feature_type"), kind, "source", "refusal", F.when(fine, F.col("geometry")).alias("geometry"), "repaired", *(F.when(fine, F.col(c)).alias(c) for c in ("coordinate_space", "source_crs")),
        F.when(fine, "DRAFT").alias("status"), F.when(fine, "UNVERIFIED").alias("verification_status"), F.when(fine & ai, "AI_PRELIMINARY").alias("ai_status"), F.col("said.confidence").alias("confidence"),
        F.when(fine, F.coalesce("said.notes", F.array().cast("array<string>"))).alias("notes"), F.when(fine, warnings).alias("warnings"), *more,
    )


def roads(rows: DataFrame, allow_multiline: bool = False) -> DataFrame:
    """Draft roads (rows with road_class): geometry_kind LINE or SURFACE, length_m along lines or around surfaces, holes included."""
    judged = declared(rows, "LineString", "road_class", ROAD_CLASSES)
    kind = F.col("geometry.kind")
    line, polygon = kind.isin(*J.LINES), kind.isin(*J.POLYGONS) & F.coalesce("said.road_surface", F.lit(False))
    short = F.exists(J.rings(F.col("geometry")), lambda r: F.size(F.array_distinct(r)) < 2)
    refusal = F.when((kind == "MultiLineString") & F.lit(not allow_multiline), "MULTILINE_NOT_ALLOWED").when(line & short, "TOO_FEW_POINTS").when(~(line | polygon), "NOT_A_ROAD_GEOMETRY")
    judged = _repaired(judged.withColumn("refusal", F.coalesce("refusal", refusal)), polygon)
    length = F.when(F.col("refusal").isNull(), P.metres_along(J.rings(F.col("geometry")), F.col("source_crs")))
    shape = F.when(F.col("refusal").isNull(), F.when(line, "LINE").otherwise("SURFACE"))
    return _result(judged, "ROAD", "road_class", ROAD_WARNING, shape.alias("geometry_kind"), length.alias("length_m"))


def land_use(rows: DataFrame, allow_multipolygon: bool = False) -> DataFrame:
    """Draft land use (rows with land_use_class): area_m2 without holes, and area_sqft."""
    judged = declared(rows, "Polygon", "land_use_class", LAND_USE_CLASSES)
    kind = F.col("geometry.kind")
    refusal = F.when((kind == "MultiPolygon") & F.lit(not allow_multipolygon), "MULTIPOLYGON_NOT_ALLOWED").when(~kind.isin(*J.POLYGONS), "NOT_A_POLYGON")
    judged = _repaired(judged.withColumn("refusal", F.coalesce("refusal", refusal)), kind.isin(*J.POLYGONS))
    area = F.when(F.col("refusal").isNull(), P.square_metres(F.col("geometry.parts"), F.col("source_crs")))
    out = _result(judged, "LAND_USE", "land_use_class", LAND_USE_WARNING, area.alias("area_m2"))
    return out.withColumn("area_sqft", G.square_feet(F.col("area_m2")))


def collections(features: DataFrame) -> DataFrame:
    """(feature_id, value): a FeatureCollection of one feature, as text, for each row that isn't refused.

    Geometries of a known system go out in degrees, and say so (export_crs); all others stay in their own coordinates. Every
    other column is a property.
    """
    fine = features.filter("refusal IS NULL")
    moved = fine.withColumn("_degrees", P.to_degrees(F.col("geometry.parts"), F.col("source_crs")))
    world = F.col("_degrees").isNotNull()
    moved = moved.withColumn("_geometry", F.struct(F.col("geometry.kind").alias("kind"), F.coalesce("_degrees", F.col("geometry.parts")).alias("parts")))
    crs = F.when(world, "EPSG:4326")
    properties = F.struct(*(c for c in fine.columns if c not in ("geometry", "refusal", "repaired")), F.coalesce(crs, F.col("source_crs")).alias("crs"))
    metadata = F.struct("feature_type", "coordinate_space", "source_crs", crs.alias("export_crs"), "status", "verification_status")
    keep = {"ignoreNullFields": "false"}
    value = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":'), J.text(F.col("_geometry")), F.lit(',"properties":'), F.to_json(properties, keep), F.lit('}],"metadata":'), F.to_json(metadata, keep), F.lit("}")
    )
    return moved.select("feature_id", value.alias("value"))
