"""Connected components of a graph given as rows, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, root: each node that has an edge to another and the smallest node of its component, itself left out.

    Each step is a groupBy-min and a join on the node, so a component's size is no one's group: minima are combined before the shuffle
    and a large neighbourhood's join side can be split. Steps are written to the shared checkpoint folder.
    """
    now = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        new = large.join(small, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(new.unionAll(small.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
