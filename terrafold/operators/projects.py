"""What a project's pages show: search over four sources, dashboard, summary, stages seen, and a validation run.

Counters are made for all projects at once, one aggregate a table; a page of one project filters the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import jobs as jobs_
from .linking import IDENTIFIER_FIELDS, area_mismatches, upsert_issues
from .paging import contains_any

#: Job states that count as stages, and kinds of assets.
STAGES = ("QUEUED", "PROCESSING", "FAILED")
ASSETS = ("IMAGERY", "GEOAI_JOB", "BUILDING", "ROAD", "LAND_USE")

HIT = ("kind", "id", "evidence_id", "title", "subtitle", "status", "matched_value", "preliminary")


def _top(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first `limit` rows, numbered: a top-k, then a window over those few."""
    few = rows.orderBy(*order).limit(limit)
    return few.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def _within(top: DataFrame, taken: DataFrame | None, limit: int) -> DataFrame:
    """Those of the numbered rows that fit in what is left of `limit`."""
    if taken is None:
        return top
    used = taken.agg(F.count("*").alias("_used"))  # one row
    return top.withColumn("_one", F.lit(1)).join(F.broadcast(used.withColumn("_one", F.lit(1))), "_one").filter(F.col("_rank") + F.col("_used") <= limit).drop("_one", "_used")


def search(documents: DataFrame, parcels: DataFrame, fields: DataFrame, corrections: DataFrame, text: str, limit: int = 30, read_fields: bool = True) -> DataFrame:
    """One project's hits in documents, parcels, fields and corrections, each filling what the ones before it left of `limit`.

    documents: document_id, name, status, updated_at. parcels: parcel_id, external_identifier, status, verification_status,
    updated_at. fields: field_id, document_id, field_name, candidate_index, original_value. corrections: field_id, version,
    corrected_value. Newest documents first, ties by id. A field counts once a document and name, a correction once a field
    that has no hit yet, after limits, so fewer rows can come back. Every source gives `limit` rows at most before anything is
    joined to another source. Without the right to read fields only the first two are searched.
    """
    query = text.strip()
    if not 2 <= len(query) <= 255 or not 1 <= limit <= 100:
        raise ValueError("the text must have 2 to 255 characters, the limit be 1 to 100")
    newest = F.desc("updated_at")
    none = F.lit(None).cast(fields.schema["field_id"].dataType)
    draft = F.col("status") != "VALIDATED"

    found = _top(documents.filter(contains_any(query, "name")), limit, newest, F.col("document_id"))
    hits = [found.select(F.lit("DOCUMENT").alias("kind"), F.col("document_id").alias("id"), none.alias("evidence_id"), F.col("name").alias("title"), F.lit("Document source").alias("subtitle"), "status", F.col("name").alias("matched_value"), draft.alias("preliminary"))]

    named = _within(_top(parcels.filter(contains_any(query, "external_identifier")), limit, newest, F.col("parcel_id")), hits[0], limit)
    unverified = F.coalesce(F.col("verification_status") != "VERIFIED", F.lit(True))
    hits.append(named.select(F.lit("PARCEL").alias("kind"), F.col("parcel_id").alias("id"), none.alias("evidence_id"), F.col("external_identifier").alias("title"), F.lit("Parcel identifier").alias("subtitle"), "status", F.col("external_identifier").alias("matched_value"), unverified.alias("preliminary")))

    def all_hits() -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), hits)

    def field_hit(value: str, subtitle: Column) -> list[Column]:
        title = F.concat(F.initcap(F.replace("field_name", F.lit("_"), F.lit(" "))), F.lit(": "), F.col(value))
        return [F.lit("FIELD").alias("kind"), F.col("document_id").alias("id"), F.col("field_id").alias("evidence_id"), title.alias("title"), subtitle.alias("subtitle"), F.col("status"), F.col(value).alias("matched_value"), draft.alias("preliminary")]

    if read_fields:
        values = fields.filter(contains_any(query, "original_value")).join(documents, "document_id")
        values = _within(_top(values, limit, newest, F.col("candidate_index"), F.col("field_id")), all_hits(), limit)
        first = Window.partitionBy("document_id", "field_name").orderBy("_rank")
        hits.append(values.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*field_hit("original_value", F.col("name"))))
        said = corrections.filter(contains_any(query, "corrected_value")).join(fields.select("field_id", "document_id", "field_name"), "field_id").join(documents, "document_id")
        said = _within(_top(said, limit, newest, F.desc("version"), F.col("field_id")), all_hits(), limit)
        said = said.join(F.broadcast(hits[2].select(F.col("evidence_id").alias("field_id"))), "field_id", "left_anti")  # `limit` rows at most
        subtitle = F.concat(F.col("name"), F.lit(" · human correction v"), F.col("version").cast("string"))
        hits.append(said.withColumn("_n", F.row_number().over(Window.partitionBy("field_id").orderBy("_rank"))).filter("_n = 1").select(*field_hit("corrected_value", subtitle)))
    return all_hits().select(*HIT)


def statuses(rows: DataFrame, name: str, status: str = "status") -> DataFrame:
    """(project_id, name): each project's statuses with their counts, in order, as an array of struct(status, n)."""
    counted = rows.groupBy("project_id", F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return counted.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("status", "n"))).alias(name))


def _beside(projects: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Every project with its counters, 0 where a table has none of its rows, and no statuses as an empty array."""
    out = reduce(lambda a, b: a.join(b, "project_id", "left"), parts, projects.select("project_id"))
    empty = F.array().cast("array<struct<status:string,n:bigint>>")
    return out.select("project_id", *(F.coalesce(c, empty if c.endswith("_statuses") else F.lit(0)).alias(c) for c in out.columns[1:]))


def dashboard(projects: DataFrame, documents: DataFrame, links: DataFrame, tasks: DataFrame, parcels: DataFrame, jobs: DataFrame, assets: DataFrame, me: object) -> DataFrame:
    """A row a project with the counters of its dashboard, as the user `me` sees them.

    All inputs have project_id. documents: document_id, status. links: document_id, link_status. tasks: status, queue_type,
    target_type, severity, assignee_id. parcels: status. jobs: status, job_type. assets: kind.
    """
    held = lambda c, *v: F.coalesce(F.col(c).isin(*v), F.lit(False))
    sure = links.filter("link_status = 'CONFIRMED'").select("project_id", "document_id").distinct()
    linked = documents.join(sure.withColumn("_linked", F.lit(True)), ["project_id", "document_id"], "left")
    valid = F.col("status") == "VALIDATED"
    of_documents = linked.groupBy("project_id").agg(
        F.count("*").alias("documents"), F.count_if(valid).alias("validated_records"), F.count_if(valid & F.col("_linked").isNull()).alias("unlinked_validated_records"),
        F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("review_required_documents"),
    )
    issue, link = held("target_type", "VALIDATION_ISSUE"), held("target_type", "RECORD_PARCEL_LINK")
    of_tasks = tasks.filter("status = 'OPEN'").groupBy("project_id").agg(
        F.count("*").alias("open_reviews"), F.count_if((F.col("queue_type") == "DOCUMENT") & F.col("target_type").isNotNull() & ~issue & ~link).alias("document_reviews"), F.count_if(F.col("queue_type") == "GIS").alias("gis_reviews"),
        F.count_if(link).alias("link_reviews"), F.count_if(F.col("severity") == "HIGH").alias("high_reviews"), F.count_if(F.col("severity") == "MEDIUM").alias("medium_reviews"),
        F.count_if(F.col("assignee_id") == me).alias("assigned_to_me"), F.count_if(issue).alias("validation_issues"),
    )
    of_parcels = parcels.groupBy("project_id").agg(F.count("*").alias("parcels"), F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("parcels_needing_review"))
    of_links = links.groupBy("project_id").agg(F.count("*").alias("links"), F.count_if(F.col("link_status") == "REVIEW_REQUIRED").alias("ambiguous_links"))
    failed = F.col("status") == "FAILED"
    of_jobs = jobs.groupBy("project_id").agg(F.count("*").alias("jobs"), F.count_if(held("status", "QUEUED", "PROCESSING")).alias("active_jobs"), F.count_if(failed).alias("failed_jobs"), F.count_if(failed & held("job_type", *jobs_.RETRYABLE)).alias("retryable_failed_jobs"))
    of_assets = assets.groupBy("project_id").agg(*(F.count_if(F.col("kind") == k).alias(f"{k.lower()}_assets") for k in ASSETS))
    confirmed = sure.groupBy("project_id").agg(F.count("*").alias("confirmed_records"))
    parts = [of_documents, of_tasks, of_parcels, of_links, confirmed, of_jobs, of_assets]
    listed = [statuses(documents, "document_statuses"), statuses(parcels, "parcel_statuses"), statuses(links, "link_statuses", "link_status"), statuses(jobs, "job_statuses")]
    return _beside(projects, [*parts, *listed])


def summary(projects: DataFrame, members: DataFrame, files: DataFrame, jobs: DataFrame, audits: DataFrame) -> DataFrame:
    """A row a project: members, files, jobs and audit rows counted, files and jobs by status too."""
    counted = [rows.groupBy("project_id").agg(F.count("*").alias(name)) for name, rows in (("members", members), ("files", files), ("jobs", jobs), ("audit_events", audits))]
    return _beside(projects, [*counted, statuses(files, "file_statuses"), statuses(jobs, "job_statuses")])


def stages(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """(project_id, stage, n): stages of the workflow that a project's rows are seen in; none without rows."""
    seen = files.filter("status = 'UPLOADED'").select("project_id", "status").unionByName(jobs.filter(F.col("status").isin(*STAGES)).select("project_id", "status"))
    return seen.groupBy("project_id", F.col("status").alias("stage")).agg(F.count("*").alias("n"))


def duplicate_issues(evidence: DataFrame) -> DataFrame:
    """Issues of identifiers that documents share. evidence: document_id, field_name, candidate_index, identifier (normalised), value."""
    rows = evidence.filter(F.col("field_name").isin(*IDENTIFIER_FIELDS) & (F.col("identifier") != ""))
    shown = F.min_by("value", F.struct("document_id", "candidate_index"))
    shared = rows.groupBy("identifier").agg(F.count_distinct("document_id").alias("n"), shown.alias("shown")).filter("n >= 2")
    text = F.concat(F.lit("Potential duplicate record: "), F.col("n").cast("string"), F.lit(" validated documents share identifier "), F.col("shown"), F.lit("."))
    return shared.select(F.concat(F.lit("duplicate-record:"), "identifier").alias("issue_key"), F.lit("HIGH").alias("severity"), text.alias("summary"))


def mismatch_issues(comparisons: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Issues of links whose areas differ. comparisons: link_id, document_area_m2, parcel_area_m2."""
    text = F.concat(F.lit("Area mismatch: validated document area and linked parcel area differ by "), F.format_string("%.1f%%", F.col("relative_difference") * 100), F.lit("."))
    return area_mismatches(comparisons, tolerance).select(F.concat(F.lit("area-mismatch:"), F.col("link_id").cast("string")).alias("issue_key"), "severity", text.alias("summary"))


def validation_run(evidence: DataFrame, comparisons: DataFrame, existing: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """A project's issues after a run: issue_key, severity, summary, status, outcome (created, refreshed, left, kept).

    existing: issue_key, severity, summary, status, created_at. Of earlier issues with one key the newest is met by the run;
    older ones stay as they are (kept).
    """
    newest = Window.partitionBy("issue_key").orderBy(F.desc("created_at"))
    aged = existing.withColumn("_n", F.row_number().over(newest))
    met = upsert_issues(aged.filter("_n = 1").drop("_n", "created_at"), duplicate_issues(evidence).unionByName(mismatch_issues(comparisons, tolerance)))
    older = aged.filter("_n > 1").select("issue_key", "severity", "summary", "status", F.lit("kept").alias("outcome"))
    return met.unionByName(older)


def run_counters(issues: DataFrame) -> DataFrame:
    """One row about a run: issues created and refreshed, and open ones in all and by type."""
    open_ = F.col("status") == "OPEN"
    return issues.agg(
        F.count_if(F.col("outcome") == "created").alias("created"), F.count_if(F.col("outcome") == "refreshed").alias("refreshed"), F.count_if(open_).alias("open_issues"),
        F.count_if(open_ & F.col("issue_key").startswith("duplicate-record:")).alias("duplicate_records"), F.count_if(open_ & F.col("issue_key").startswith("area-mismatch:")).alias("area_mismatches"),
    )
