"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for each id with a link; root is the least id of its component.

    Large-star and small-star steps in turn: each step links a node's neighbours to the least of them, so
    the number of links never grows and a component of n ids is a star after O(log n) rounds. Each round
    is a table in the shared folder. Self-links are dropped, repeated links don't matter."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # every node's smaller neighbours and the node itself to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u != v").distinct(), "links")
        # done when every node has one link and roots have none upwards
        n, d, s = edges.agg(F.count("*"), F.count_distinct("u"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).collect()[0]
        if (n, s) == before and n == d:
            break
        before = (n, s)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
