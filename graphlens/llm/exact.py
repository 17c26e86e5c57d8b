"""Exact duplicates: a 128-bit content hash groups the texts, and the texts themselves decide inside a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash=None) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    ``keep``: "min" or "max" id of a group of equal texts stays. ``content_hash`` maps a text column to the grouping
    hash (128-bit MD5 unless tests force collisions). Texts are equal when their bytes are; null counts as empty.

    Rows are grouped by hash *and* bytes, with one row per distinct text and map task going through the shuffle, so a
    hot text is aggregated before it moves and a hash collision cannot join two texts. The groups then return to the
    rows by that hash and the SHA-256 of their bytes.

    Defined results: null id - the row is a member like any other, ids of a group ignore nulls (keep_id null if all
    are), and a null id is never kept beside a real one; equal ids with equal text - all such rows are kept; empty
    table - no rows. Further columns of ``docs`` are not read.
    """
    content_hash = content_hash or (lambda text: F.unhex(F.md5(text)))
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body")).select("id", "body", content_hash(F.col("body")).alias("h"), F.sha2("body", 256).alias("sha"))
    pick = F.min if keep == "min" else F.max
    groups = rows.groupBy("h", "body").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Bytes are compared by the grouping above; the digest of the bytes names each class on the way back to the rows.
    classes = groups.select(F.col("h").alias("gh"), F.sha2("body", 256).alias("gsha"), "keep_id", "group_size")
    rows = rows.select("id", "h", "sha")
    joined = rows.join(classes, (F.col("h") == F.col("gh")) & (F.col("sha") == F.col("gsha")))
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
