"""GeoJSON geometries of all simple types, read and written by column expressions.

A geometry is struct(kind, parts): `kind` is its GeoJSON type, `parts` are polygons of rings of points, whatever the kind. A
polygon is its outer ring and then its holes; a line is a part of one "ring", a point is a part of one "ring" of one point. So one schema holds
points, lines, polygons and their multiples; third coordinates are dropped, collections of geometries are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import RING

PARTS = f"array<array<{RING}>>"
GEOMETRY = f"struct<kind:string,parts:{PARTS}>"
#: How deep a kind's positions are nested.
DEPTHS = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
LINES, POLYGONS = ("LineString", "MultiLineString"), ("Polygon", "MultiPolygon")

_POSITION = "array<double>"


def _nested(depth: int) -> str:
    return "array<" * depth + _POSITION + ">" * depth


def _each(depth: int, value: Column, of) -> Column:
    """Applies a function to the positions of nested arrays."""
    return of(value) if depth == 0 else F.transform(value, lambda v: _each(depth - 1, v, of))


def _point(position: Column) -> Column:
    return F.struct(F.get(position, F.lit(0)).alias("x"), F.get(position, F.lit(1)).alias("y"))


def _parts(kind: str, coordinates: Column) -> Column:
    """Parts of a kind from its coordinates as JSON; null where they don't parse."""
    depth = DEPTHS[kind]
    c = _each(depth, F.from_json(coordinates, _nested(depth)), _point)
    one = {"Point": lambda: F.array(F.array(F.array(c))), "LineString": lambda: F.array(F.array(c)), "Polygon": lambda: F.array(c), "MultiPolygon": lambda: c}
    many = {"MultiPoint": lambda: F.transform(c, lambda p: F.array(F.array(p))), "MultiLineString": lambda: F.transform(c, lambda line: F.array(line))}
    return F.when(c.isNotNull(), (one | many)[kind]())


def read(rows: DataFrame, column: str, expected: str) -> DataFrame:
    """Rows with `geometry`, `properties` and `unreadable`, read from a text column: a geometry, a feature, a collection of one feature, or bare coordinates of the expected kind.

    properties is the JSON text of the feature's properties, or of the object itself where it is no feature.
    unreadable is null or one of NOT_AN_OBJECT, NOT_ONE_FEATURE, NO_GEOMETRY, UNKNOWN_KIND, BAD_COORDINATES, EMPTY_GEOMETRY. Each step is a
    column of its own, so that no step is worked out again wherever it is used.
    """
    get, col = F.get_json_object, F.col
    features = F.from_json(col(column), "struct<features:array<string>>")["features"]
    steps = rows.withColumns({"_type": get(column, "$.type"), "_object": F.startswith(F.ltrim(col(column)), F.lit("{")) & get(column, "$").isNotNull()})
    wrapped = F.coalesce(col("_type").isin("Feature", "FeatureCollection"), F.lit(False))
    steps = steps.withColumn("_feature", F.when(col("_type") == "FeatureCollection", F.when(F.size(features) == 1, features[0])).when(col("_type") == "Feature", col(column)))
    steps = steps.withColumn("_inner", F.when(wrapped, get("_feature", "$.geometry")).otherwise(col(column)))
    steps = steps.withColumns({"_coordinates": get("_inner", "$.coordinates"), "_kind": F.coalesce(get("_inner", "$.type"), F.when(~wrapped, F.lit(expected)))})
    parts = F.lit(None).cast(PARTS)
    for name in DEPTHS:
        parts = F.when(col("_kind") == name, _parts(name, col("_coordinates"))).otherwise(parts)
    steps = steps.withColumn("_parts", parts).withColumn("_points", F.flatten(F.flatten("_parts")))
    bad = F.exists("_points", lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]))
    why = (
        F.when(~F.coalesce("_object", F.lit(False)), "NOT_AN_OBJECT").when((col("_type") == "FeatureCollection") & col("_feature").isNull(), "NOT_ONE_FEATURE").when(col("_coordinates").isNull(), "NO_GEOMETRY")
        .when(~F.coalesce(col("_kind").isin(*DEPTHS), F.lit(False)), "UNKNOWN_KIND").when(F.coalesce(bad, F.lit(True)), "BAD_COORDINATES").when(F.size("_points") == 0, "EMPTY_GEOMETRY")
    )
    steps = steps.withColumn("unreadable", why).withColumn("properties", F.when(col("_feature").isNotNull(), get("_feature", "$.properties")).otherwise(col(column)))
    geometry = F.when(col("unreadable").isNull(), F.struct(col("_kind").alias("kind"), col("_parts").alias("parts")))
    # one row a row: filters on the result aren't spelled out in terms of the text, step by step
    return steps.select(*rows.columns, F.inline(F.array(F.struct(geometry.alias("geometry"), "properties", "unreadable"))))


def text(geometry: Column) -> Column:
    """A geometry as GeoJSON text, null for null."""
    parts = geometry["parts"]
    pair = lambda p: F.array(p["x"], p["y"])
    ring = lambda r: F.transform(r, pair)
    shaped = {
        "Point": lambda: pair(parts[0][0][0]), "MultiPoint": lambda: F.transform(parts, lambda p: pair(p[0][0])), "LineString": lambda: ring(parts[0][0]),
        "MultiLineString": lambda: F.transform(parts, lambda p: ring(p[0])), "Polygon": lambda: F.transform(parts[0], ring), "MultiPolygon": lambda: F.transform(parts, lambda p: F.transform(p, ring)),
    }
    out = F.lit(None).cast("string")
    for kind in DEPTHS:
        out = F.when(geometry["kind"] == kind, F.to_json(F.struct(geometry["kind"].alias("type"), shaped[kind]().alias("coordinates")))).otherwise(out)
    return F.when(F.size(parts) > 0, out)


def of_polygons(polygons: Column) -> Column:
    """Polygons (functions.overlay) as a geometry of the kind that holds them."""
    return F.struct(F.when(F.size(polygons) == 1, "Polygon").otherwise("MultiPolygon").alias("kind"), polygons.alias("parts"))


def rings(geometry: Column) -> Column:
    """All rings or lines of a geometry."""
    return F.flatten(geometry["parts"])
