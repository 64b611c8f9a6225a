"""Connected components over links, by minimum labels and pointer jumping.

Every round is grouped minima (combined before the shuffle) and equi-joins, so a node with very many links is no single
task's burden; each round is written to the shared folder, which also ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); nodes of one component share their smallest node as label."""
    spark = links.sparkSession
    base = scratch(spark)
    both = stored(links.select("a", "b").unionAll(links.select("b", "a")).where("a <> b").distinct(), f"{base}/links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{base}/0")
    at = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = stored(labels.join(near, "node").select("node", F.least("label", "near").alias("mid"), F.col("label").alias("old")), f"{base}/low{at}")  # so that the next join can split a hot label
        up = low.select(F.col("node").alias("mid"), F.col("mid").alias("top"))
        new = stored(low.join(up, "mid").select("node", F.least("mid", "top").alias("label"), (F.least("mid", "top") != F.col("old")).alias("moved")), f"{base}/{at + 1}")
        moved = new.where("moved").limit(1).count()
        remove(spark, f"{base}/{at}")
        remove(spark, f"{base}/low{at}")
        at += 1
        labels = new.select("node", "label")
        if not moved:
            remove(spark, f"{base}/links")
            return labels
