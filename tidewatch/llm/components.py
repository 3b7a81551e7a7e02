"""Connected components of a table of links, by alternating stars; every step is joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest reachable node) of every node that has a link to another one.

    ``links`` has two columns of numbers. Each round first hangs every node's larger
    neighbours on its smallest neighbour, then its smaller ones; the rounds end when every
    node hangs on its root. A node with many links is aggregated before the shuffle, and
    joins of such nodes are split by Spark.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = settle(edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        hung = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = settle(hung.where("u <> v").distinct(), "links")
        # A star forest stays as it is; equal sums mean that nothing moved.
        after = tuple(edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
