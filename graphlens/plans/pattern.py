"""Pattern matching: hops from an anchor, each branch aggregated by itself before it joins the anchor again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.columns import collect_distinct
from graphlens.graph import Graph


@dataclass(frozen=True)
class Hop:
    """One edge from where a branch stands: its type and ends, the direction, and the edge properties to keep."""

    edge: str
    source: str
    target: str
    reverse: bool = False
    keep: tuple[str, ...] = ()


def out(edge: str, source: str, target: str, *keep: str) -> Hop:
    return Hop(edge, source, target, False, keep)


def into(edge: str, source: str, target: str, *keep: str) -> Hop:
    """The edge source -> target, walked from target to source."""
    return Hop(edge, source, target, True, keep)


def ends(graph: Graph, start: DataFrame, *hops: Hop) -> DataFrame:
    """(anchor, at, kept edge properties): the ids that the hops lead to; ``start`` has columns anchor and at.

    Edges carry the ends' ids only, so nodes on the way are not read.
    """
    rows = start.select("anchor", "at")
    kept: list[str] = []
    for hop in hops:
        edges = graph.edges[hop.edge, hop.source, hop.target]
        here, there = ("dst", "src") if hop.reverse else ("src", "dst")
        step = edges.select(F.col(here).alias("at"), F.col(there).alias("to"), *[F.col(c).alias(f"edge_{c}") for c in hop.keep])
        rows = rows.join(step, "at").select("anchor", F.col("to").alias("at"), *[c for c in kept], *[f"edge_{c}" for c in hop.keep])
        kept += [f"edge_{c}" for c in hop.keep]
    return rows.distinct()


def walk(graph: Graph, start: DataFrame, *hops: Hop) -> DataFrame:
    """(anchor, node columns, kept edge properties) of the last hop's nodes; ``start`` has columns anchor and at."""
    label = hops[-1].source if hops[-1].reverse else hops[-1].target
    nodes, rows = graph.nodes[label], ends(graph, start, *hops)
    return rows.join(nodes.drop("project"), rows["at"] == nodes["id"]).drop("at")


def anchors(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("anchor"), F.col("id").alias("at"))


def gather(rows: DataFrame, name: str, *what: Column) -> DataFrame:
    """(anchor, name): the distinct values, or records of several columns, that each anchor reaches."""
    value = what[0] if len(what) == 1 else F.struct(*what)
    return rows.groupBy("anchor").agg(collect_distinct(value).alias(name))


def gather_parts(rows: DataFrame, name: str, value: Column, *keys: str, parts: int = 512) -> DataFrame:
    """(keys, name): as ``gather``, for long lists of few keys (anchor, if none is given).

    A list's values are told apart in parts, by their hash, so that no task holds the sets of all keys; a key's parts meet as arrays.
    """
    keys = keys or ("anchor",)
    part = F.pmod(F.xxhash64("value"), F.lit(parts)).alias("part")
    sets = rows.select(*keys, value.alias("value")).groupBy(*keys, part).agg(F.collect_set("value").alias("values"))
    return sets.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("values"))).alias(name))


def assemble(nodes: DataFrame, *branches: DataFrame) -> DataFrame:
    """The anchor nodes with every branch's list; an anchor that a branch does not reach has an empty list.

    Each branch is one row per anchor here, so several branches never multiply each other's rows.
    """
    rows = nodes
    for branch in branches:
        rows = rows.join(branch.withColumnRenamed("anchor", "id"), "id", "left")
    filled = []
    kinds = {f.name: f.dataType for b in branches for f in b.schema.fields if f.name != "anchor"}
    for c in rows.columns:
        filled.append(F.coalesce(c, F.array().cast(kinds[c])).alias(c) if c in kinds and kinds[c].typeName() == "array" else F.col(c))
    return rows.select(*filled)
