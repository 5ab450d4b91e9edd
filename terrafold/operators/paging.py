"""Filters, pages, searches and set operations over lists."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: list[Column | None]) -> Column:
    """Conjunction of the conditions that are given; none is true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def filtered(rows: DataFrame, equal: Mapping[str, object] | None = None, one_of: Mapping[str, list] | None = None, none_of: Mapping[str, list] | None = None, where: list[Column | None] | None = None) -> DataFrame:
    """Optional equality, IN and NOT IN filters; a None value means no filter."""
    conditions = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    conditions += [F.col(c).isin(*v) for c, v in (one_of or {}).items() if v is not None]
    conditions += [~F.col(c).isin(*v) for c, v in (none_of or {}).items() if v is not None]
    return rows.filter(all_of([*conditions, *(where or [])]))


def contains_any(text: str, *columns: str, fold: str = "ilike") -> Column:
    """OR of substring matches; % and _ in the text stay wildcards. fold: ilike, or lower (lower(column) LIKE)."""
    hits = [F.col(c).ilike(f"%{text}%") if fold == "ilike" else F.lower(c).like(f"%{text.lower()}%") for c in columns]
    return reduce(lambda a, b: a | b, hits)


def page(rows: DataFrame, *order: Column | str, limit: int = 50, offset: int = 0, most: int = 100) -> DataFrame:
    """One page in a total order: give a unique last key. The limit is bounded, so a page is a top-k, not a full sort."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most}, offset 0 or more")
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_after(rows: DataFrame, keys: dict[str, str], last: dict[str, object] | None = None, limit: int = 50, most: int = 100) -> DataFrame:
    """The page behind a row: keys are columns and their directions (asc or desc) in a total order, none of them null; `last` has their values in that row.

    Whatever page it is, a task keeps `limit` rows, where an offset would keep all rows before it too.
    """
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")
    beyond, tied = F.lit(last is None), F.lit(True)
    for name, way in keys.items():
        if last is not None:
            value = F.lit(last[name])
            beyond = beyond | (tied & (F.col(name) < value if way == "desc" else F.col(name) > value))
            tied = tied & (F.col(name) == value)
    return rows.filter(beyond).orderBy(*(F.desc(c) if way == "desc" else F.asc(c) for c, way in keys.items())).limit(limit)


def page_with_total(rows: DataFrame, *order: Column | str, limit: int = 50, offset: int = 0, most: int = 100) -> DataFrame:
    """The page with the count of all rows beside each of its rows."""
    total = rows.agg(F.count("*").alias("total"))
    # one row on either side: the count joins as a constant
    return page(rows, *order, limit=limit, offset=offset, most=most).withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")


def ranked_search(sources: list[DataFrame], limit: int, key: list[str]) -> DataFrame:
    """Results of several sources, in their order, within one budget.

    Each source (columns kind, id, label, sub; ordered by id) fills what the ones before it left of `limit`; copies of
    `key` go after that, so fewer than `limit` rows can come back. Each source contributes `limit` rows at most, by a
    top-k, whatever it holds.
    """
    tops = [s.orderBy("id").limit(limit).withColumn("source_rank", F.lit(k)) for k, s in enumerate(sources)]
    all_ = reduce(lambda a, b: a.unionByName(b), tops)
    budget = all_.orderBy("source_rank", "id").limit(limit)
    first = budget.groupBy(*key).agg(F.min(F.struct("source_rank", "id")).alias("_first"))
    return budget.join(F.broadcast(first), key).filter((F.col("source_rank") == F.col("_first.source_rank")) & (F.col("id") == F.col("_first.id"))).drop("_first")


def without(rows: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose (non-null) key isn't in other: NOT IN as an anti join."""
    return rows.join(other.select(*([on] if isinstance(on, str) else on)), on, "left_anti")


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, in_left, in_right) of every key on either side, as for images and masks by stem."""
    a, b = left.select(key).distinct().withColumn("in_left", F.lit(True)), right.select(key).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))
