"""Confidence, difference and rating expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH")


def ocr_confidence(raw: Column) -> Column:
    """0 to 100, perhaps as text, to 0 to 1; negative or unreadable is null."""
    value = raw.try_cast("double")
    return F.when((value >= 0) & ~F.isnan(value), F.least(F.greatest(value / 100, F.lit(0.0)), F.lit(1.0)))


def clamp(c: Column) -> Column:
    """Between 0 and 1; null stays null (least and greatest would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def extraction_confidence(mean_ocr: Column, same_line: Column, normalized: Column) -> Column:
    """Confidence of a candidate from its words' mean; null where no word has one."""
    return clamp(0.75 * mean_ocr + 0.15 + F.when(same_line, 0.05).otherwise(0.03) + F.when(normalized, 0.05).otherwise(0.0))


def confidence_band(c: Column, high: float = 0.90, medium: float = 0.75) -> Column:
    return F.when(c.isNull(), "UNKNOWN").when(c >= high, "HIGH").when(c >= medium, "MEDIUM").otherwise("LOW")


def relative_difference(a: Column, b: Column) -> Column:
    """Difference over the larger; null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.abs(a - b) / F.greatest(a, b))


def rounded(c: Column, digits: int) -> Column:
    """A double at so many digits as SQL engines round it, by its binary product with 10**digits, halves away from zero.

    Spark's round goes by the shortest decimal text instead, so the two part where the product is a half and the text isn't. Below 2**53 / 10**digits.
    """
    size = F.abs(c) * F.lit(10.0**digits)
    whole = F.floor(size).cast("double")
    up = F.when(size - whole >= 0.5, whole + 1).otherwise(whole) / F.lit(10.0**digits)
    return F.when(size < 2.0**53, F.when(c < 0, -up).otherwise(up)).otherwise(c)


def percent_change(before: Column, after: Column) -> Column:
    return F.when(before > 0, (after - before) / before * 100)


def severity_rank(c: Column) -> Column:
    rank = F.lit(None).cast("int")
    for k, name in enumerate(SEVERITIES):
        rank = F.when(c == name, k).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.coalesce(rank, F.lit(0)) + 1).cast("int"))


def link_score(admin_matches: Column, admin_conflicts: Column, area_ok: Column) -> Column:
    """Record to parcel: 0.90 for the identifier, 0.03 for each of two administrative matches and for the area, -0.45 a conflict.

    The terms are added in this order, as binary sums depend on it.
    """
    score = F.lit(0.90) + F.least(admin_matches, F.lit(2)) * F.lit(0.03)
    score = F.when(area_ok, score + F.lit(0.03)).otherwise(score)
    return clamp(score - admin_conflicts * F.lit(0.45))
