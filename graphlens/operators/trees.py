"""Values along the way from a root, for every node of a forest: ways are joined two at a time, whatever their length."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.sources.config import shared_folder

Keep = Callable[[str, DataFrame], DataFrame]


def checkpointed(name: str, rows: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder: what is made from them in rounds has a plan that does not grow."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)


def from_roots(nodes: DataFrame, value: str, join: Callable[[Column, Column], Column], key: list[str] | None = None, keep: Keep = checkpointed, name: str = "ways") -> DataFrame:
    """(key, node, value, depth) of the nodes that a root leads to: ``join``, which must be associative, of the values on the way.

    ``nodes`` has the columns key, node, parent (null for roots) and value. A node whose parent is missing is left out. The
    number of rounds is the logarithm of the greatest depth; a ring, which no root leads to, raises ValueError.
    """
    key = key or []
    rows = nodes.select(*key, "node", F.col("parent").alias("at"), F.col(value).alias("value"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    found = keep(f"{name}_0", rows)
    rounds = None
    k = 0
    while not found.where("at is not null").isEmpty():
        if rounds is None:
            rounds = 2 + math.ceil(math.log2(max(2, found.count())))
        if k >= rounds:
            raise ValueError("the tree has a ring: some nodes are their own ancestors")
        k += 1
        above = found.select(*key, F.col("node").alias("at"), F.col("at").alias("next"), F.col("value").alias("above"), F.col("depth").alias("more"))
        led = found.where("at is not null").join(above, [*key, "at"]).select(*key, "node", F.col("next").alias("at"), join(F.col("above"), F.col("value")).alias("value"), (F.col("depth") + F.col("more")).alias("depth"))
        found = keep(f"{name}_{k}", found.where("at is null").unionByName(led))
    return found.drop("at")
