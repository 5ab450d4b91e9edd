"""Rollups, counters and exports. Each source table is read once, whatever the number of counters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(rows: DataFrame, status: str = "status", where: Column | None = None) -> DataFrame:
    """(status, n): counts by status."""
    return (rows if where is None else rows.filter(where)).groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def pivoted(rows: DataFrame, status: str, values: list[str]) -> DataFrame:
    """One row with a count for each value, 0 where there is none."""
    return rows.agg(*(F.count_if(F.col(status) == v).alias(v) for v in values))


def counters(**tables: tuple[DataFrame, Mapping[str, Column]]) -> DataFrame:
    """One row of named aggregates over several tables, each read once."""
    parts = [rows.agg(*(c.alias(name) for name, c in named.items())).withColumn("_one", F.lit(1)) for rows, named in tables.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part), "_one")  # one row on either side
    return out.drop("_one")


def attention(counts: DataFrame, named: Mapping[str, str], key: list[str] | None = None) -> DataFrame:
    """(key, position, label, n): counters that are above 0, in the order of `named` (column to label)."""
    entries = F.array(*(F.struct(F.lit(k).alias("position"), F.lit(label).alias("label"), F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("n")) for k, (c, label) in enumerate(named.items())))
    return counts.select(*(key or []), F.inline(entries)).filter("n > 0")


def records_export(documents: DataFrame, files: DataFrame, fields: DataFrame, corrections: DataFrame, validations: DataFrame, columns: tuple[str, ...], missing: str | None = "") -> DataFrame:
    """A row a document: file name, status, latest validation status, and each field's first value with corrections; `missing` for what isn't there."""
    fixed = corrections.groupBy(F.col("extracted_field_id").alias("id")).agg(F.max_by("corrected_value", "version").alias("fix"))
    # a version's first values at once, then the newest version of them: fields are dealt by document and version once, and small rows go on
    mine = lambda c: F.col("field_name") == c
    firsts = [F.min_by(F.when(mine(c), F.coalesce("fix", "original_value")), F.when(mine(c), F.col("candidate_index"))).alias(c) for c in columns]
    held = fields.join(fixed, "id", "left").groupBy("document_id", "version").agg(*firsts)
    wide = held.groupBy("document_id").agg(F.max_by(F.struct(*columns), "version").alias("_f")).select("document_id", *(F.col("_f")[c].alias(c) for c in columns))
    checked = validations.groupBy("document_id").agg(F.max_by("status", "version").alias("validation_status"))
    joined = documents.join(files.select(F.col("id").alias("file_id"), "original_name"), "file_id", "left").join(wide, "document_id", "left").join(checked, "document_id", "left")
    return joined.select("document_id", *(F.coalesce(F.col(c), F.lit(missing)).alias(c) for c in ("original_name", "status", "validation_status", *columns)))


#: The header of the records export, and the note on every row.
RECORD_COLUMNS = ("document_id", "filename", "workflow_status", "validation_status", "survey_number", "parcel_identifier", "plot_area", "village", "district", "evidence_note")
EVIDENCE_NOTE = "Workflow evidence only; AI-extracted or human-corrected values are not statutory ownership proof."


def records_csv(documents: DataFrame, files: DataFrame, fields: DataFrame, corrections: DataFrame, validations: DataFrame, permissions: set[str]) -> DataFrame:
    """The records export: RECORD_COLUMNS, all text, a row a document.

    Field values show to those who may read fields, and those of validated documents to those who may read records; to others they are ''.
    A parcel without its own identifier is named by the cadastral one.
    """
    wide = records_export(documents, files, fields, corrections, validations, ("survey_number", "parcel_identifier", "cadastral_identifier", "plot_area", "village", "district"), missing=None)
    may = F.lit("field:read" in permissions) | (F.lit("record:read" in permissions) & F.coalesce(F.col("status") == "VALIDATED", F.lit(False)))
    shown = {c: F.when(may, F.col(c)) for c in ("survey_number", "plot_area", "village", "district")}
    shown |= {"document_id": F.col("document_id").cast("string"), "filename": F.col("original_name"), "workflow_status": F.col("status"), "validation_status": F.col("validation_status")}
    shown |= {"parcel_identifier": F.when(may, F.coalesce("parcel_identifier", "cadastral_identifier")), "evidence_note": F.lit(EVIDENCE_NOTE)}
    return wide.select(*(F.coalesce(shown[c], F.lit("")).alias(c) for c in RECORD_COLUMNS))


def audit_page(logs: DataFrame, equal: Mapping[str, object] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest audit rows first, filtered, metadata redacted once more on reading (of the page's rows only)."""
    from ..functions.text import redact_json
    from .paging import filtered, page

    return page(filtered(logs, equal), F.desc("created_at"), "id", limit=limit, offset=offset).withColumn("metadata_json", redact_json(F.col("metadata_json")))


def map_extent(features: DataFrame, ring: str = "ring") -> DataFrame:
    """One row: least and greatest coordinates of all features."""
    from ..functions.geometry import bounds

    b = features.select(bounds(F.col(ring)).alias("b"))
    return b.agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))
