"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlens.llm.common import dealt_join, drop_path, new_path


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (id, component): the smallest id reachable, for every id in a link.

    Each round hangs every node on the least of its neighbours with joins and aggregates of minima (never a list of a
    node's neighbours) and writes the links to the shared folder, which cuts the lineage. The number of rounds grows
    with the logarithm of the longest path. Loops, repeated links and links with a null end are left out.
    """
    spark = links.sparkSession
    path = new_path(spark, "links")
    links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().write.parquet(path)
    before = None
    while True:
        now = spark.read.schema("u long, v long").parquet(path)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
        before = state
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("m"))
        large = dealt_join(both.filter("y > x"), least, "x", "y").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s")).select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).filter("u <> v").distinct()
        after = new_path(spark, "links")
        small.write.parquet(after)
        drop_path(spark, path)
        path = after
