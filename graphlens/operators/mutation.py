"""Graph mutation as pure functions: insert, upsert, edge resolution, gate, wipe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append; duplicates stay."""
    return old.unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Add the keys that are missing; rows that are there stay as they are. Keys are equal when null together."""
    return old.unionByName(_anti(new.dropDuplicates(key), old, key), allowMissingColumns=True)


def _anti(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    known = right.select(*[F.col(c).alias(f"k_{c}") for c in key]).distinct()
    return left.join(known, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key]), "left_anti")


def upsert_set(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Add or overwrite: where a key is in ``new``, its values replace the old ones, nulls too."""
    return _anti(old, new, key).unionByName(new.dropDuplicates(key), allowMissingColumns=True)


def upsert_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key; every other column has the first value in the order that is not null."""
    rest = [c for c in rows.columns if c not in key]
    place = F.struct(*order)
    return rows.groupBy(*key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in rest])


def gated(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Only rows of projects that exist."""
    return rows.join(projects.select(F.col("name").alias("project")).distinct(), "project", "left_semi")


def resolve_edges(facts: DataFrame, source: DataFrame, target: DataFrame, source_key: dict[str, str], target_key: dict[str, str], properties: list[str] | None = None) -> DataFrame:
    """Edges (project, src, dst, properties) from facts that name both ends by natural keys.

    Keys map a fact's columns to a node table's. A fact whose end is unknown gives no edge; one that names several nodes
    gives an edge to each; equal edges count once, properties included.
    """
    properties = properties or []
    sources = source.select("project", F.col("id").alias("src"), *[F.col(n).alias(f) for f, n in source_key.items()])
    targets = target.select("project", F.col("id").alias("dst"), *[F.col(n).alias(f) for f, n in target_key.items()])
    joined = facts.join(sources, ["project", *source_key]).join(targets, ["project", *target_key])
    return joined.select("project", "src", "dst", *properties).distinct()


def implied_nodes(*paths: DataFrame) -> DataFrame:
    """The nodes that edges name: the distinct (project, path) of several frames."""
    return reduce(DataFrame.union, [p.select("project", "path") for p in paths]).distinct()


def wipe(nodes: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame], labels: list[str], project: str) -> tuple[dict, dict]:
    """Remove the labels' nodes of a project, with every edge that has such an end."""
    kept = {k: (v.where(~F.col("project").eqNullSafe(project)) if k in labels else v) for k, v in nodes.items()}
    left = {k: (v.where(~F.col("project").eqNullSafe(project)) if k[1] in labels or k[2] in labels else v) for k, v in edges.items()}
    return kept, left
