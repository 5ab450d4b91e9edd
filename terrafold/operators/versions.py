"""Versions: latest, valid, pointed to, corrected, next; first candidates and running numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str | list[str], *newest_first: Column, where: Column | None = None) -> DataFrame:
    """A key's newest row. `where` filters before ranking, so a newer row that fails it hides nothing.

    Only rank 1 is asked for, so Spark prunes each task's rows to one a key before the shuffle.
    """
    keys = [key] if isinstance(key, str) else key
    rows = rows if where is None else rows.filter(where)
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first)))
    return ranked.filter("_rank = 1").drop("_rank")


def overlay(base: DataFrame, corrections: DataFrame, key: str, value: str, corrected: str, version: str) -> DataFrame:
    """Base rows with the newest correction in place of the value, where there is one."""
    newest = corrections.groupBy(key).agg(F.max_by(corrected, version).alias("_corrected"))
    return base.join(newest, key, "left").withColumn(value, F.coalesce("_corrected", value)).drop("_corrected")


def pointed(parents: DataFrame, versions: DataFrame, on: list[Column], how: str = "inner") -> DataFrame:
    """The version that a parent points to, by key and number, not the largest."""
    return parents.join(versions, on, how)


def next_version(parents: DataFrame, versions: DataFrame, key: str, version: str) -> DataFrame:
    """(key, next_version): one above the largest, 1 without any."""
    top = versions.groupBy(key).agg(F.max(version).alias("_top"))
    return parents.select(key).join(top, key, "left").select(key, (F.coalesce("_top", F.lit(0)) + 1).alias("next_version"))


def first_candidate(rows: DataFrame, key: list[str], order: str, *values: str) -> DataFrame:
    """A key's values in its first row by order; partial aggregates meet in the shuffle, not rows."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*values), order).alias("_v")).select(*key, "_v.*")


def numbered(rows: DataFrame, key: str | list[str], *order: Column, name: str = "candidate_index") -> DataFrame:
    """Running number from 0 within a key."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def with_next(rows: DataFrame, key: str | list[str], *order: Column, column: str, name: str) -> DataFrame:
    """Look-ahead: the next row's column within a key."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn(name, F.lead(column).over(Window.partitionBy(*keys).orderBy(*order)))


def append_version(current: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies edits (parcel_id, expected_version, geometry) under an optimistic lock.

    Returns new versions (parcel_id, version, geometry) and rejected edits with the reason: no such parcel, a version
    that isn't current, or another edit of the same parcel in the batch that came first by edit_id.
    """
    joined = edits.join(current.select("parcel_id", F.col("version").alias("_now")), "parcel_id", "left")
    order = F.row_number().over(Window.partitionBy("parcel_id", F.col("expected_version") == F.col("_now")).orderBy("edit_id"))
    judged = joined.withColumn("reason", F.when(F.col("_now").isNull(), "NOT_FOUND").when(F.col("expected_version") != F.col("_now"), "VERSION_CONFLICT").when(order > 1, "VERSION_CONFLICT"))
    new = judged.filter("reason IS NULL").select("parcel_id", (F.col("_now") + 1).alias("version"), "geometry")
    return new, judged.filter("reason IS NOT NULL").select("edit_id", "parcel_id", "reason")
