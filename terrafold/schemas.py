"""Table schemas, and their constraints as data-quality rules.

Tables are Parquet; keys are UUID text in lower case, which sorts as the bytes do. Uniqueness and check constraints
don't hold by themselves on files: `violations` counts what breaks them, one pass a table for checks and one
aggregation a uniqueness rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STAMPS = "created_at timestamp, updated_at timestamp"

#: Columns of every table.
TABLES: dict[str, str] = {
    "users": f"id string, login_id string, email string, password_hash string, full_name string, is_active boolean, {_STAMPS}",
    "roles": f"id string, name string, description string, {_STAMPS}",
    "permissions": f"id string, code string, {_STAMPS}",
    "user_roles": "user_id string, role_id string",
    "role_permissions": "role_id string, permission_id string",
    "auth_sessions": f"id string, user_id string, token_digest string, expires_at timestamp, revoked_at timestamp, {_STAMPS}",
    "projects": f"id string, name string, description string, state string, owner_id string, {_STAMPS}",
    "project_members": f"project_id string, user_id string, role string, {_STAMPS}",
    "files": f"id string, project_id string, original_name string, category string, mime_type string, size_bytes long, sha256 string, storage_key string, status string, {_STAMPS}",
    "processing_jobs": f"id string, project_id string, file_id string, job_type string, status string, idempotency_key string, progress int, retry_count int, error_json string, {_STAMPS}",
    "imagery_assets": f"id string, project_id string, file_id string, source_crs string, coordinate_space string, metadata_json string, {_STAMPS}",
    "geoai_jobs": f"id string, project_id string, processing_job_id string, imagery_asset_id string, job_type string, parameters_json string, metrics_json string, output_json string, {_STAMPS}",
    "parcels": f"id string, project_id string, external_identifier string, source string, source_reference string, status string, verification_status string, current_geometry_version int, confidence double, requires_survey boolean, metadata_json string, {_STAMPS}",
    "parcel_geometry_versions": f"id string, parcel_id string, version int, geometry string, source_geometry_json string, area_m2 double, area_sqft double, validation_status string, created_by_type string, {_STAMPS}",
    "buildings": f"id string, project_id string, geometry string, confidence double, area_m2 double, area_sqft double, status string, {_STAMPS}",
    "roads": f"id string, project_id string, geometry string, road_class string, confidence double, length_m double, status string, {_STAMPS}",
    "land_use_features": f"id string, project_id string, geometry string, land_use_class string, confidence double, area_m2 double, status string, {_STAMPS}",
    "topology_errors": f"id string, project_id string, parcel_id string, related_parcel_id string, code string, severity string, area_m2 double, resolved boolean, {_STAMPS}",
    "audit_logs": "id string, project_id string, actor_id string, action string, target_type string, target_id string, metadata_json string, created_at timestamp",
    "documents": f"id string, project_id string, file_id string, status string, {_STAMPS}",
    "document_processing_jobs": f"id string, document_id string, processing_job_id string, languages array<string>, processing_version int, job_type string, {_STAMPS}",
    "document_ocr_results": f"id string, document_id string, processing_job_id string, version int, engine string, page_count int, confidence double, payload_json string, {_STAMPS}",
    "document_extracted_fields": f"id string, document_id string, ocr_result_id string, candidate_index int, field_name string, original_value string, normalized_value_json string, confidence double, page_number int, bounding_box_json string, {_STAMPS}",
    "document_validation_results": f"id string, document_id string, ocr_result_id string, version int, status string, report_json string, confidence_json string, checks_json string, review_task_id string, {_STAMPS}",
    "document_field_corrections": f"id string, extracted_field_id string, version int, corrected_value string, reason string, {_STAMPS}",
    "record_parcel_links": f"id string, project_id string, validation_result_id string, parcel_id string, link_status string, link_method string, confidence double, rationale_json string, provenance_json string, {_STAMPS}",
    "review_tasks": f"id string, project_id string, queue_type string, target_type string, target_id string, severity string, status string, summary string, source_refs array<string>, metadata_json string, blocking_issue_count int, {_STAMPS}",
}

NORMALIZED_VALUE = "struct<kind:string,text:string,value:double,unit:string,entries:array<struct<value:string,dates:array<string>>>>"
BOX = "struct<left:int,top:int,width:int,height:int>"
TOKENS = f"document_id string, page_number int, region_number int, text string, confidence double, box {BOX}"

#: State vocabularies.
VOCABULARIES: dict[tuple[str, str], tuple[str, ...]] = {
    ("projects", "state"): ("ACTIVE", "ARCHIVED"),
    ("processing_jobs", "status"): ("QUEUED", "PROCESSING", "COMPLETED", "FAILED", "CANCELLED"),
    ("documents", "status"): ("UPLOADED", "QUEUED", "PROCESSING", "EXTRACTED", "VALIDATING", "REVIEW_REQUIRED", "VALIDATED", "FAILED"),
    ("files", "category"): ("DOCUMENT", "IMAGERY", "GIS", "SUPPORTING"),
    ("record_parcel_links", "link_status"): ("SUGGESTED", "REVIEW_REQUIRED", "CONFIRMED", "REJECTED"),
    ("review_tasks", "queue_type"): ("DOCUMENT", "GEOSPATIAL"),
    ("review_tasks", "severity"): ("INFO", "LOW", "MEDIUM", "HIGH"),
    ("review_tasks", "status"): ("OPEN", "RESOLVED"),
}


@dataclass(frozen=True)
class Unique:
    """Values of `columns` occur once among the rows where `where` holds."""

    columns: tuple[str, ...]
    where: str = "true"


UNIQUE: dict[str, tuple[Unique, ...]] = {
    "users": (Unique(("login_id",)), Unique(("email",))),
    "roles": (Unique(("name",)),),
    "permissions": (Unique(("code",)),),
    "auth_sessions": (Unique(("token_digest",)),),
    "projects": (Unique(("owner_id", "name")),),
    "project_members": (Unique(("project_id", "user_id")),),
    "processing_jobs": (Unique(("project_id", "idempotency_key")),),
    "imagery_assets": (Unique(("file_id",)),),
    "parcel_geometry_versions": (Unique(("parcel_id", "version")),),
    "documents": (Unique(("file_id",)),),
    "document_ocr_results": (Unique(("document_id", "version")), Unique(("processing_job_id",), "processing_job_id IS NOT NULL")),
    "document_extracted_fields": (Unique(("ocr_result_id", "candidate_index")),),
    "document_validation_results": (Unique(("document_id", "version")),),
    "document_field_corrections": (Unique(("extracted_field_id", "version")),),
    "record_parcel_links": (
        Unique(("validation_result_id", "parcel_id"), "link_status IN ('SUGGESTED', 'REVIEW_REQUIRED', 'CONFIRMED')"),
        Unique(("validation_result_id",), "link_status = 'CONFIRMED'"),
    ),
}

CHECKS: dict[str, dict[str, str]] = {
    "users": {"login_id_format": "login_id RLIKE '^(ADM|OFF|REV|SUR|VWR)-TN-[0-9]{6,}$'"},
    "files": {"size": "size_bytes >= 0", "sha256_length": "length(sha256) = 64"},
    "processing_jobs": {"progress": "progress BETWEEN 0 AND 100"},
    "parcels": {"version": "current_geometry_version >= 1"},
}


def violations(table: str, rows: DataFrame) -> DataFrame:
    """(rule, broken): rows that break each check or vocabulary, and surplus rows of each uniqueness rule."""
    checks = dict(CHECKS.get(table, {}))
    for (name, column), values in VOCABULARIES.items():
        if name == table:
            checks[f"{column}_values"] = f"{column} IN ({', '.join(repr(v) for v in values)})"
    spark = rows.sparkSession
    out = spark.createDataFrame([], "rule string, broken long")
    if checks:
        counted = rows.agg(*(F.count_if(~F.expr(rule)).alias(name) for name, rule in checks.items()))
        out = out.unionByName(counted.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in checks))).alias("r")).select("r.*"))
    for rule in UNIQUE.get(table, ()):
        surplus = rows.filter(rule.where).groupBy(*rule.columns).count().filter("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("broken"))
        out = out.unionByName(surplus.select(F.lit("unique_" + "_".join(rule.columns)).alias("rule"), F.col("broken").cast("long")))
    return out
