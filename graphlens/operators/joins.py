"""Joins that plain equality does not express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.paths import directory_prefixes, prefixes


def prefix_join(values: DataFrame, heads: DataFrame, value: str, prefix: str, on: list[str] | None = None, how: str = "inner", directories: bool = False) -> DataFrame:
    """Rows of both sides where ``value`` starts with a nonempty ``prefix``, and the ``on`` columns are equal.

    The value's own prefixes are joined by equality, so the join shuffles or broadcasts like any other; the naive
    condition would compare every pair within a project. Only prefixes as long as some prefix of the same ``on`` columns
    are tried; with ``directories`` every prefix ends in a slash, and only those of a value are. ``how``: inner,
    left_semi or left_anti (of the values).
    """
    on = on or []
    if on and not directories:
        # One row per project, of no more numbers than its longest prefix has characters.
        lengths = heads.where(F.length(prefix) > 0).groupBy(*on).agg(F.collect_set(F.length(prefix)).alias("lengths_"))
        tried = F.transform(F.filter("lengths_", lambda n: n <= F.length(value)), lambda n: F.substring(F.col(value), F.lit(1), n))
        keyed = values.join(F.broadcast(lengths), on).withColumn("prefix_", F.explode(tried)).drop("lengths_")
    else:
        keyed = values.withColumn("prefix_", F.explode((directory_prefixes if directories else prefixes)(F.col(value))))
    right = heads.where(F.length(prefix) > 0).withColumnRenamed(prefix, "prefix_") if prefix != value else heads.where(F.length(prefix) > 0).withColumn("prefix_", F.col(prefix)).drop(prefix)
    if how == "inner":
        return keyed.join(right.withColumn(prefix, F.col("prefix_")), [*on, "prefix_"]).drop("prefix_")
    hit = keyed.join(right.select(*on, "prefix_").distinct(), [*on, "prefix_"], "left_semi").select(*on, value).distinct()
    same = [values[c].eqNullSafe(hit[c]) for c in [*on, value]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return values.join(hit, condition, how)
