"""Queries against their SQL on rows that only larger tables hold, and plans that don't gather a large table."""

import os

import pytest
from pyspark.sql import functions as F

from terrafold.plans import catalog

from .conftest import DATA
from .test_catalog import rows_of


@pytest.fixture
def made(spark, tmp_path):
    """A folder of the given tables, the others as in sf0.001, and DuckDB's views of it."""
    duckdb = pytest.importorskip("duckdb")

    def build(**tables):
        con = duckdb.connect()
        for name in os.listdir(f"{DATA}/sf0.001"):
            path = tmp_path / name
            frame = tables.get(name.split(".")[0])
            if frame is None:
                os.symlink(f"{DATA}/sf0.001/{name}", path)
            else:
                frame.toPandas().to_parquet(path, coerce_timestamps="us")
            con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
        return str(tmp_path), con

    return build


def equal(spark, built, name):
    folder, con = built
    df, want = catalog.QUERIES[name](spark, folder), con.sql(catalog.ORACLE[name])
    as_they_are = lambda columns, rows: sorted(([r[k] for k in sorted(range(len(columns)), key=lambda k: columns[k])] for r in rows), key=str)
    got, sought = as_they_are(df.columns, df.collect()), as_they_are(want.columns, want.fetchall())
    assert len(got) > 0 and got == sought


def test_link_suggestions_of_zero_areas_and_halves(spark, made):
    customer = spark.createDataFrame([(8, "a", 3, 0.0, "x"), (9, "b", 4, 307.2, "x"), (10, "c", 5, -1408.0, "x"), (11, "d", 6, 55.5, "x")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    orders = [(4, 8, 2000.0), (5, 9, 11415.96), (7, 10, 60595.15), (8, 11, 2775.0), (9, 9, 5000.0)]
    orders = spark.createDataFrame([(k, c, "O", p, "1-URGENT") for k, c, p in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").withColumn("o_orderdate", F.timestamp_seconds(F.lit(0)))
    equal(spark, made(customer=customer, orders=orders), "link_suggestions")


def test_band_stretch_deals_no_rows_by_band(spark):
    from terrafold.functions import raster as R

    pixels = spark.range(4000).select((F.col("id") % 3).alias("band"), (F.col("id") * 7919 % 10_007).cast("double").alias("v"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to send around
    try:
        df = R.band_stretch(pixels, "band", "v")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2  # of ranks and of percentiles, a few rows a band; all that pixels take part in are broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_shapes_of_one_file_are_worked_on_by_all_cores(spark):
    from terrafold.functions import geometry as G
    from terrafold.operators import cadastre, shapes

    x = (F.col("id") * 9).cast("double")
    rows = spark.range(60).coalesce(1).select(F.col("id").alias("shape_id"), F.array(G.rectangle(x, F.lit(0.0), x + 10, F.lit(10.0))).alias("rings"))
    held = lambda df: len({r[0] for r in df.select(F.spark_partition_id()).collect()})
    assert held(shapes.pieces(rows)) > 1 and held(shapes.met(rows, rows)) > 1
    assert held(cadastre.overlaps(rows.select(F.col("shape_id").alias("parcel_id"), F.col("rings")[0].alias("ring")))) > 1
    assert shapes.overlaps(rows).count() == 59


def test_a_step_of_scans_is_done_once(spark):
    from terrafold.operators import scans

    rows = spark.range(200).select((F.col("id") % 5).alias("image_id"), F.floor(F.col("id") / 5).alias("row"), F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: (k * 37 + F.col("id") * 11) % 256).cast("array<int>").alias("levels"))
    made, seen = scans.prepared(rows, threshold=True)
    plan = made.join(seen, "image_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "_up" not in plan and made.count() == 200  # medians lie behind a kept table


def test_projected_areas_are_worked_on_by_all_cores(spark, tables):
    df = catalog.projected_areas(spark, tables[0])
    assert len({r[0] for r in df.select(F.spark_partition_id()).collect()}) > 1


def test_records_export_deals_lines_once_and_without_their_ids(spark, tables):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.records_export(spark, tables[0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("lineitem.parquet") == 1 and "concat_ws" not in plan and "ShuffledHashJoin" in plan


def test_masks_leave_a_task_in_small_batches(spark, monkeypatch):
    import pandas as pd

    from terrafold.operators import cadastre

    sizes = []
    frame = spark.range(1).select(F.col("id").alias("mask_id"), F.array(*(F.lit(1.0) for _ in range(4))).alias("values"))
    monkeypatch.setattr(type(frame), "mapInPandas", lambda self, work, schema: sizes.extend(len(p) for p in work(iter([pd.DataFrame({"mask_id": range(1000), "values": [[1.0, 0.0, 0.0, 1.0]] * 1000})]))))
    cadastre.vectorize(frame, 2)
    assert sum(sizes) == 1000 and max(sizes) <= 256
