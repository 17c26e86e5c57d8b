"""The corpus pipeline: each stage works on all that the one before it kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import decontaminate, lines, pieces, simhash, toxicity
from graphlens.llm.common import cut, fresh_name, release
from graphlens.llm.queries import TOKENIZER

ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.3 go; texts are not changed. Null texts score as empty ones and stay null."""
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines are cut from the texts; every document stays, null and empty texts as they are."""
    return lines.remove_repeated_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id. Null and wordless texts are one group."""
    return simhash.simhash_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark spans are cut from the others. Null texts stay null; without items nothing changes."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, and whether decoding gives its text back; null and empty texts have no ids."""
    out = pieces.encode(docs, TOKENIZER, decoded="decoded")
    decoded = out.columns[-1]
    return out.withColumn(fresh_name(docs, "round_trip"), F.coalesce("text", F.lit("")) == F.col(decoded)).drop(decoded)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on the documents; what a stage keeps is written once, in the shared checkpoint folder.

    A stage's rows are deleted there as soon as the next one's are written; the last stage reads those of the one before.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            if before is not None:
                release(before)
            before = docs
    return docs
