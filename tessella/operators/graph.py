"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import materialize, release


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b), as a written table; the root is the smallest
    node reachable. Each round only groups by node and joins the minima back. Minima are combined before
    their shuffle and written before their join, so that a hub's edges can be split at run time."""
    e = materialize(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = materialize(spark, both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        lows = materialize(spark, large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(lows, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        old, e = e, materialize(spark, small, "edges")
        release(old, least, large, lows)
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = materialize(spark, nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    release(e)
    return out
