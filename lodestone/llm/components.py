"""Connected components by alternating large and small stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of `links` (longs): component is the least node reachable.

    Each round moves every node's neighbours to the least one among them; a round's minima are grouped aggregates with
    map-side parts joined back, so that a node with very many links is no single task's.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.write(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "links")
    before = None
    while True:
        facts = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if facts == before or not facts["n"]:
            break
        before = facts
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct()
        down = scratch.write(down, "large")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges_new = scratch.write(small.where("u <> v").distinct(), "small")
        scratch.drop(edges)
        scratch.drop(down)
        edges = edges_new
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
