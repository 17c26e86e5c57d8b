"""Contiguous shards of equal size: byte prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.common import cut


def with_prefix(rows: DataFrame, order: list[str], sizes: list[str], partitions: int | None = None) -> tuple[DataFrame, list[int]]:
    """The rows with ``before_<size>``: the sum of a size over all rows that come earlier in the order; and the sums over all.

    The rows are dealt by range of the order and written once, so that all later steps see the same partitions; a
    partition's total is one row, and the running sum over those few rows is the only step in one task. Rows that
    tie in the whole order get an arbitrary but gapless sequence.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(*[F.sum(s).alias(f"sum_{s}") for s in sizes])
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *[F.coalesce(F.sum(f"sum_{s}").over(upto), F.lit(0)).alias(f"off_{s}") for s in sizes])
    inside = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"in_{s}") for s in sizes])
    whole = totals.agg(*[F.coalesce(F.sum(f"sum_{s}"), F.lit(0)) for s in sizes]).first()
    # One row per partition: its number is bounded by the number of partitions asked for.
    out = summed.join(F.broadcast(offsets), "part")
    return out.select(*rows.columns, *[(F.col(f"off_{s}") + F.col(f"in_{s}")).alias(f"before_{s}") for s in sizes]), list(whole)


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per document: ``id_col``, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) and ``overhead``. Documents are taken in the order of the smallest id that
    has their text, then of their own id, so that equal texts stand together. A document goes to the shard in whose equal
    share of all bytes its own middle byte lies; a group of equal texts goes as a whole to that of the group's middle byte,
    if it has no more bytes than the largest document. Shards are contiguous ranges of the order, and each one's total is
    within twice the largest document of the target. slot counts from 0 inside a shard.

    Defined results: null texts count as empty ones; null ids come first; equal ids are ordered by checksum and size; a
    document longer than a whole share fills its shard alone and neighbours may stay empty; groups of more bytes than the
    largest document are parted like other rows; empty table - no rows. Further columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.unhex(F.md5(text)).alias("h"),
    )
    # Joined back by another key than the grouping's, so that a text of many rows can be split between tasks.
    groups = rows.groupBy("h").agg(F.min("id").alias("first_id"), F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("copies"))
    groups = groups.where("copies > 1").select(F.reverse("h").alias("back"), "first_id", "group_size")
    rows = rows.withColumn("back", F.reverse("h")).join(groups, "back", "left")
    rows = rows.select("id", "size", "crc", F.coalesce("first_id", "id").alias("first_id"), F.col("h").alias("text_id"), F.coalesce("group_size", "size").alias("group_size"), F.lit(1).cast("long").alias("one"))
    placed, (total, _) = with_prefix(rows, ["first_id", "text_id", "id", "crc", "size"], ["size", "one"])
    placed = cut(placed)
    largest = placed.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    starts = placed.groupBy("text_id").agg(F.min("before_size").alias("group_before")).select(F.reverse("text_id").alias("back"), "group_before")
    together = F.col("group_size") <= largest
    placed = placed.withColumn("back", F.reverse("text_id")).join(starts, "back")
    begin, length = F.when(together, F.col("group_before")).otherwise(F.col("before_size")), F.when(together, F.col("group_size")).otherwise(F.col("size"))
    placed = placed.withColumn("begin", begin).withColumn("length", length)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * begin + length) * {shards} div {max(1, 2 * total)}")).cast("int"))
    first = placed.groupBy("shard").agg(F.min("before_one").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before_one") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
