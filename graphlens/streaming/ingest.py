"""New JSON record files into a table of the latest record per natural key, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphlens.sources.records import BATCHES


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one of the greatest order."""
    rest = F.struct(*[c for c in rows.columns if c not in key])
    return rows.groupBy(*key).agg(F.max_by(rest, F.struct(*order)).alias("r")).select(*key, "r.*")


def ingest(spark: SparkSession, source: str, kind: str, key: list[str], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Watch a folder for files of a kind of record; each micro-batch appends its latest record per key to ``target``.

    Batches are told apart by their number, so a batch that is run again replaces itself. ``current`` reads the table.
    """
    stream = spark.readStream.schema(BATCHES[kind]).json(source).withColumn("read_from", F.col("_metadata.file_modification_time"))

    def write(rows: DataFrame, number: int) -> None:
        latest(rows, key, ["read_from"]).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, target: str, key: list[str]) -> DataFrame:
    """The table's latest record per key."""
    return latest(spark.read.parquet(target), key, ["batch", "read_from"]).drop("batch", "read_from")
