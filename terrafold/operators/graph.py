"""Connected components of a table of links, within groups."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """The table as a checkpoint in the folder that spark.checkpoint.dir names; local sessions without one get a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset: checkpoints need a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="terrafold-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores, before Python looks at each of them: a small table lies in one file, and so in one task, but may hold hours of work."""
    spark = rows.sparkSession
    return rows.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def components(links: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, node, component): every node of the links with the smallest node that it reaches in its group; nodes without links are absent.

    Two steps alternate until a round changes nothing: nodes hang their larger neighbours on their smallest one, then themselves and their smaller
    neighbours on the smallest of those. Paths shrink by a constant factor a round; a round is a checkpoint, and two checksums reach the driver.
    """
    edges = links.select(group, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges, seen = cut_lineage(edges), None
    while True:
        both = edges.select(group, "u", "v").unionByName(edges.select(group, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(group, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.filter("v > u").join(least, [group, "u"]).select(group, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy(group, "u").agg(F.min("v").alias("m"))
        hung = edges.join(least, [group, "u"]).select(group, F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        edges = cut_lineage(hung.unionByName(least.select(group, "u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64(group, "u", "v"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(group, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(group, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
