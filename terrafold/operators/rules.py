"""Validation rules as functions from candidates to issues, and what follows from issues.

Candidates: document_id, field_name, candidate_index, original_value, normalized (tagged struct), confidence, page_number.
Every rule returns the same issue columns, so a report is a union in fixed order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import confidence_band, severity_name, severity_rank

ISSUE = "document_id string, rule_order int, code string, severity string, field_name string, candidate_index int, review_required boolean, rule_id string, source_ref string"
AREA_UNITS = ("sq_ft", "sq_m", "acre", "hectare")


@dataclass(frozen=True)
class Policy:
    """Thresholds as data."""

    required_fields: tuple[str, ...] = ()
    high: float = 0.90
    medium: float = 0.75
    unknown_needs_review: bool = True
    low_blocks: bool = False
    identifier_patterns: dict[str, str] = field(default_factory=lambda: {f: T.IDENTIFIER_PATTERN for f in T.IDENTIFIERS})
    duplicate_threshold: float = 0.90
    blocking_master_fields: tuple[str, ...] = ()


def usable(candidates: DataFrame) -> DataFrame:
    return candidates.filter(~T.is_blank(F.col("original_value")))


def _issues(rows: DataFrame, order: int, code: str, severity: str, rule_id, review: bool = True, index: bool = True, field_name=None) -> DataFrame:
    text = lambda v: v if not isinstance(v, str) else F.lit(v)
    ref = T.evidence_ref(F.lit("DOCUMENT"), F.col("document_id"), F.col("page_number")) if "page_number" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "document_id", F.lit(order).alias("rule_order"), F.lit(code).alias("code"), text(severity).alias("severity"), (F.col("field_name") if field_name is None else field_name).alias("field_name"),
        (F.col("candidate_index") if index else F.lit(None)).cast("int").alias("candidate_index"), F.lit(review).alias("review_required"), text(rule_id).alias("rule_id"), ref.alias("source_ref"),
    )


def required_fields(documents: DataFrame, candidates: DataFrame, policy: Policy) -> DataFrame:
    """Required fields without a usable candidate."""
    wanted = documents.select("document_id", F.explode(F.array(*map(F.lit, policy.required_fields)) if policy.required_fields else F.array().cast("array<string>")).alias("field_name"))
    return _issues(wanted.join(usable(candidates).select("document_id", "field_name"), ["document_id", "field_name"], "left_anti"), 1, "REQUIRED_FIELD_MISSING", "HIGH", F.concat(F.lit("REQUIRED."), F.upper("field_name")), index=False)


def fields_agree(left: Column, right: Column) -> Column:
    """The cross-field rule: CROSS_FIELD_MISMATCH where two values differ, null where they are equal; a missing value equals only a missing one."""
    return F.when(~left.eqNullSafe(right), "CROSS_FIELD_MISMATCH")


def confidence(candidates: DataFrame, policy: Policy) -> DataFrame:
    rows = usable(candidates)
    unknown = _issues(rows.filter("confidence IS NULL"), 2, "UNKNOWN_CONFIDENCE", "MEDIUM", "CONFIDENCE.UNKNOWN") if policy.unknown_needs_review else None
    low = _issues(rows.filter(F.col("confidence") < policy.medium), 2, "LOW_CONFIDENCE", "MEDIUM", "CONFIDENCE.LOW")
    return low if unknown is None else unknown.unionByName(low)


def identifier_format(candidates: DataFrame, policy: Policy) -> DataFrame:
    """Identifiers whose normalised text doesn't have the field's pattern; blank ones have none to check."""
    broken = F.lit(False)
    for name, pattern in policy.identifier_patterns.items():
        broken = broken | ((F.col("field_name") == name) & ~T.matches_format(F.col("normalized.text"), pattern))
    rows = usable(candidates).filter(F.col("normalized.kind") == "text").filter(~T.is_blank(F.col("normalized.text"))).filter(broken)
    return _issues(rows, 3, "INVALID_FIELD_FORMAT", "MEDIUM", F.concat(F.lit("FORMAT."), F.upper("field_name")))


def plot_area(candidates: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Plot areas that aren't positive numbers with a known unit."""
    fine = (F.col("normalized.kind") == "area") & (F.col("normalized.value") > 0) & F.col("normalized.unit").isin(*AREA_UNITS)
    rows = usable(candidates).filter(F.col("field_name") == "plot_area").filter(~F.coalesce(fine, F.lit(False)))
    return _issues(rows, 4, "INVALID_PLOT_AREA", "MEDIUM", "AREA.POSITIVE_SUPPORTED_UNIT")


def conflicting(candidates: DataFrame) -> DataFrame:
    """document_id, field_name, values (how many distinct ones), page_number (the first): fields with more than one distinct value."""
    value = F.when(F.col("normalized.kind").isNotNull(), T.semantic_value(F.col("normalized"))).otherwise(F.to_json(F.struct("original_value")))
    return usable(candidates).groupBy("document_id", "field_name").agg(F.count_distinct(value).alias("values"), F.min("page_number").alias("page_number")).filter("values > 1")


def conflicts(candidates: DataFrame, policy: Policy | None = None) -> DataFrame:
    """An issue a field with more than one distinct value."""
    return _issues(conflicting(candidates), 5, "FIELD_VALUE_CONFLICT", "MEDIUM", F.concat(F.lit("CONFLICT."), F.upper("field_name")), index=False)


def duplicates(scores: DataFrame, policy: Policy) -> DataFrame:
    """Issues of an outside detector's scores (document_id, score)."""
    rows = scores.filter(F.col("score") >= policy.duplicate_threshold)
    return _issues(rows, 6, "POSSIBLE_DUPLICATE_RECORD", "HIGH", "DUPLICATE.SCORE", index=False, field_name=F.lit(None).cast("string"))


def master_data(checks: DataFrame, policy: Policy) -> DataFrame:
    """Issues of outside verification results (document_id, field_name, verified)."""
    severity = F.when(F.col("field_name").isin(*policy.blocking_master_fields), "HIGH").otherwise("MEDIUM") if policy.blocking_master_fields else F.lit("MEDIUM")
    return _issues(checks.filter("NOT verified"), 7, "MASTER_DATA_VERIFICATION_FAILED", severity, F.concat(F.lit("MASTER."), F.upper("field_name")), index=False)


class Registry:
    """Rules by entity type: functions that take and return DataFrames; a rule's id is unique."""

    def __init__(self) -> None:
        self._rules: dict[str, dict[str, Callable[..., DataFrame]]] = {}

    def add(self, entity: str, rule_id: str, rule: Callable[..., DataFrame]) -> None:
        if any(rule_id in rules for rules in self._rules.values()):
            raise ValueError(f"rule {rule_id} is registered already")
        self._rules.setdefault(entity, {})[rule_id] = rule

    def run(self, spark: SparkSession, entity: str, *inputs) -> DataFrame:
        found = [rule(*inputs) for rule in self._rules.get(entity, {}).values()]
        return reduce(lambda a, b: a.unionByName(b), found, spark.createDataFrame([], ISSUE))


def validate(documents: DataFrame, candidates: DataFrame, policy: Policy = Policy(), duplicate_scores: DataFrame | None = None, master_checks: DataFrame | None = None) -> DataFrame:
    """All issues of all documents. Checks without their input aren't performed."""
    found = [required_fields(documents, candidates, policy), confidence(candidates, policy), identifier_format(candidates, policy), plot_area(candidates), conflicts(candidates)]
    if duplicate_scores is not None:
        found.append(duplicates(duplicate_scores, policy))
    if master_checks is not None:
        found.append(master_data(master_checks, policy))
    return reduce(lambda a, b: a.unionByName(b), found)


def blocking(policy: Policy):
    identifier = F.col("field_name").isin(*T.IDENTIFIERS)
    out = (F.col("code") == "REQUIRED_FIELD_MISSING") | (F.col("code").isin("FIELD_VALUE_CONFLICT", "INVALID_FIELD_FORMAT") & identifier)
    if policy.required_fields:
        out = out | ((F.col("code") == "INVALID_PLOT_AREA") & F.col("field_name").isin(*policy.required_fields))
    if policy.blocking_master_fields:
        out = out | ((F.col("code") == "MASTER_DATA_VERIFICATION_FAILED") & F.col("field_name").isin(*policy.blocking_master_fields))
    return out | (F.col("code") == "LOW_CONFIDENCE") if policy.low_blocks else out


def report(documents: DataFrame, issues: DataFrame, policy: Policy = Policy(), unsafe=None) -> DataFrame:
    """document_id, status, review_required, severity, issues, blocking_issue_count, source_refs.

    INVALID for unsafe documents (a condition on documents), else REVIEW_REQUIRED if an issue asks for it or is MEDIUM or
    HIGH, else VALID. INVALID documents aren't sent to review.
    """
    asks = F.col("review_required") | F.col("severity").isin("MEDIUM", "HIGH")
    per = issues.groupBy("document_id").agg(
        F.bool_or(asks).alias("asks"), F.max(severity_rank(F.col("severity"))).alias("rank"), F.count("*").alias("issues"), F.count_if(F.coalesce(blocking(policy), F.lit(False))).alias("blocking"),
        F.array_sort(F.collect_set("source_ref")).alias("refs"),
    )
    joined = documents.join(per, "document_id", "left")
    status = F.when(F.coalesce(F.col("asks"), F.lit(False)), "REVIEW_REQUIRED").otherwise("VALID")
    status = status if unsafe is None else F.when(unsafe, "INVALID").otherwise(status)
    need = status == "REVIEW_REQUIRED"
    return joined.select(
        "document_id", status.alias("status"), need.alias("review_required"), F.when(need, severity_name(F.col("rank"))).otherwise("INFO").alias("severity"), F.coalesce("issues", F.lit(0)).alias("issues"),
        F.when(need, F.col("blocking")).otherwise(0).alias("blocking_issue_count"), F.when(need, F.col("refs")).otherwise(F.array().cast("array<string>")).alias("source_refs"),
    )


def confidence_summary(candidates: DataFrame, fields_per_document: int, policy: Policy = Policy()) -> DataFrame:
    """document_id, value, band and counts: the least representative confidence, unknown if any candidate's is unknown."""
    per_field = usable(candidates).groupBy("document_id", "field_name").agg(F.min("confidence").alias("least"), F.count_if(F.col("confidence").isNull()).alias("unknown"))
    needed = F.count_if(F.col("field_name").isin(*policy.required_fields)) == len(set(policy.required_fields)) if policy.required_fields else F.lit(True)
    per = per_field.groupBy("document_id").agg(
        F.min("least").alias("least"), F.count("least").alias("contributing_fields"), F.count_if((F.col("unknown") > 0) | F.col("least").isNull()).alias("unknown_fields"), F.count("*").alias("present"), needed.alias("complete"),
    )
    value = F.when((F.col("unknown_fields") == 0) & F.col("complete"), F.col("least"))
    return per.select("document_id", value.alias("value"), confidence_band(value, policy.high, policy.medium).alias("band"), "contributing_fields", (F.lit(fields_per_document) - F.col("present")).alias("missing_fields"), "unknown_fields")
