"""Every registered query against the SQL that gives the same rows."""

import math

import pytest

from terrafold.plans import catalog


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, tables, name):
    folder, con = tables
    df = catalog.QUERIES[name](spark, folder)
    want = con.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_gives_rows(spark, tables, name):
    assert catalog.QUERIES[name](spark, tables[0]).count() > 0


def test_pages_are_top_k_and_filters_reach_the_scan(spark, tables):
    plan = catalog.list_page(spark, tables[0])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan or "Limit" in plan
    plan = catalog.filtered_page(spark, tables[0])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "o_orderdate" not in plan
