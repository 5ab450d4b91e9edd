"""Sinks: CSV and GeoJSON exports, append-only tables, JSON reports. Writers refuse to overwrite unless told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import redact_json

def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", "true").option("escape", '"').csv(path)


def geojson_feature(ring: Column, properties: Column, identifier: Column) -> Column:
    """A Feature as JSON text, null for a null ring."""
    coordinates = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(F.lit("Feature").alias("type"), identifier.cast("string").alias("id"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties"))
    return F.when(ring.isNotNull(), F.to_json(feature, {"ignoreNullFields": "false"}))


def parcel_features(parcels: DataFrame) -> DataFrame:
    """One JSON line a parcel with a geometry: preliminary unless verified, no legal boundary asserted."""
    preliminary = F.coalesce(F.col("verification_status") != "VERIFIED", F.lit(True))
    properties = F.struct("external_identifier", "status", "verification_status", preliminary.alias("preliminary"), F.lit(False).alias("legal_boundary_asserted"))
    return parcels.select(geojson_feature(F.col("ring"), properties, F.col("parcel_id")).alias("value")).filter("value IS NOT NULL")


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited GeoJSON: one feature a line, in as many files as there are partitions."""
    features.select("value").write.mode("errorifexists").text(path)


def collection(features: DataFrame, most: int = 1000) -> DataFrame:
    """One row: a FeatureCollection of all features, for viewers. More than `most` are refused when it is read; they go out line by line or in `pages`."""
    few = features.limit(most + 1).agg(F.collect_list("value").alias("v"), F.count("*").alias("n"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort("v"), ","), F.lit("]}"))
    return few.select(F.when(F.col("n") <= most, text).otherwise(F.raise_error(F.lit(f"more than {most} features: write them as lines, or in pages"))).alias("value"))


def pages(features: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """(page, after, value): all features (key, value) as FeatureCollections of at most `most`, in the order of their distinct keys.

    `after` is the key before a page's first one (null for the first page). Keys are range-partitioned, and a page lies within a partition, so
    none passes through one task; partitions' last pages may be shorter.
    """
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = features.select(F.col(key).alias("_key"), "value").repartitionByRange(parts, "_key").withColumn("_part", F.spark_partition_id())
    numbered = sorted_.selectExpr("*", "row_number() OVER (PARTITION BY _part ORDER BY _key) - 1 AS _n")
    listed = numbered.groupBy("_part", F.floor(F.col("_n") / most).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_key", "value"))).alias("v"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("v", lambda x: x["value"]), ","), F.lit("]}"))
    page = listed.select("_part", "_block", F.element_at("v", -1)["_key"].alias("_last"), text.alias("value"))
    # a row a page from here on
    return page.selectExpr("row_number() OVER (ORDER BY _part, _block) - 1 AS page", "lag(_last) OVER (ORDER BY _part, _block) AS after", "value")



def append_once(existing: DataFrame, rows: DataFrame, key: list[str], path: str) -> None:
    """Appends rows whose key isn't there yet, so a repeated run adds nothing."""
    rows.dropDuplicates(key).join(existing.select(*key), key, "left_anti").write.mode("append").parquet(path)


def private_objects(existing: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects (storage_key, content_type, content) as they would be stored, with size_bytes, sha256 and `refused`.

    A key that is stored already, or that comes again in the batch, is refused: originals are never replaced. Of a batch's objects of one key the one
    of least sha256 goes in. Store those that aren't refused with append_once, which checks the keys once more.
    """
    stored = existing.select("storage_key", F.lit(True).alias("_stored")).distinct()
    rows = objects.withColumn("size_bytes", F.length("content").cast("long")).withColumn("sha256", F.sha2("content", 256)).join(stored, "storage_key", "left")
    place = F.row_number().over(Window.partitionBy("storage_key").orderBy("sha256"))
    return rows.withColumn("refused", F.coalesce("_stored", F.lit(False)) | (place > 1)).drop("_stored")


def audit_rows(rows: DataFrame) -> DataFrame:
    """Audit rows with their metadata redacted, ready to append."""
    return rows.withColumn("metadata_json", redact_json(F.col("metadata_json")))


def write_report(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)


def export_manifest(spark, project_id: str) -> DataFrame:
    """Descriptors of a project's two exports."""
    return spark.createDataFrame(
        [("records_csv", "text/csv", f"projects/{project_id}/exports/records.csv"), ("parcels_geojson", "application/geo+json", f"projects/{project_id}/exports/parcels.geojson")],
        "name string, content_type string, path string",
    )
