"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.llm.common import stage


def _star(links: DataFrame) -> DataFrame:
    """Link every neighbour of u to the least of u and its neighbours; links are (u, v) rows."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u").select(F.col("v"), "m")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (columns u and v, any one orderable type); root is the component's least node.

    Each round rewrites all links by joins on their nodes; a node of very many links is no group that any task holds. The
    number of rounds grows with the logarithm of the longest path. Self links and repeats do no harm; no links, no rows.
    """
    links = stage(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: over neighbours below u, and u itself.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        links = stage(small.where("u != v").distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first())
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
