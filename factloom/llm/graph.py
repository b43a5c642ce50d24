"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """For links (a, b) between bigint nodes: (node, component), component being the least node that is reachable.

    Large-star and small-star steps in turn: each node's neighbours are tied to their least one, until every node hangs on
    its component's least node. The number of rounds grows with the logarithm of a component's size. Each round is written
    to the shared folder, so lost executors cost no more than a round. Nothing is gathered by node: a node with a million
    links is a minimum and a join. Self-links give a component of one node; null ends are passed over.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    alone = links.where("a = b").select("a", "b")
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.*").where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).union(alone.select(F.col("a").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
