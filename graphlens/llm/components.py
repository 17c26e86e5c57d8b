"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import cut, release


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of a link with the smallest node that it can reach.

    A round groups by node with partial aggregates and joins the minimum back by a key that is not the grouping's, so
    both sides are dealt anew and a hub's rows can be split between tasks. Each round's links are written to the shared
    folder and the round's before are deleted. The links shrink to one star per component, and the rounds end when
    none changes.

    Defined results: links to oneself and repeated or turned links count once or not at all, so a node that has no other
    link is not in the result; nodes must not be null; no links - no rows; links that have not settled after
    ``max_rounds`` rounds raise.
    """
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    links = cut(links)
    before = None
    for _ in range(max_rounds):
        # Large star: a node's larger neighbours link to its smallest neighbour or itself.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.bitwise_not("a").alias("not_a"), F.least("a", "low").alias("m"))
        large = both.withColumn("not_a", F.bitwise_not("a")).join(low, "not_a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node's smaller neighbours and itself link to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.bitwise_not("a").alias("not_a"), "m")
        small = large.withColumn("not_a", F.bitwise_not("a")).join(low, "not_a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        last, links = links, cut(small)
        release(last)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
