"""Source trees: one row per file with its path below a root and, where wanted, its whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions.matches import unix_lines


def _below(path, root: str):
    """The part of a file URL after the root, whatever scheme and host stand before it."""
    bare = root.rstrip("/").split("://")[-1]
    return F.regexp_extract(path, f"\\Q{bare}\\E/(.*)$", 1)


def read_texts(spark: SparkSession, root: str, pattern: str = "*", project: str | None = None, recursive: bool = True) -> DataFrame:
    """(project, path, text) of the files whose name fits a glob, outside node_modules, with \\n line ends.

    Files that cannot be read are skipped; bytes that are no UTF-8 become U+FFFD.
    """
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    rows = reader.text(root, wholetext=True).select(_below(F.col("_metadata.file_path"), root).alias("path"), unix_lines(F.col("value")).alias("text"))
    return rows.where(~F.array_contains(F.split("path", "/"), "node_modules")).select(F.lit(project).alias("project"), "path", "text")


def list_files(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """(project, path, size) of the files below a root that are not empty; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select(F.lit(project).alias("project"), _below(F.col("path"), root).alias("path"), F.col("length").alias("size"))


def rejected_files(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(project, path, reason) of listed files that gave no text, or one with bytes that are no UTF-8."""
    lost = files.join(texts.select("project", "path"), ["project", "path"], "left_anti").select("project", "path", F.lit("not readable").alias("reason"))
    return lost.unionByName(texts.where(F.contains("text", F.lit("\ufffd"))).select("project", "path", F.lit("not UTF-8").alias("reason")))


def count_sources(files: DataFrame) -> DataFrame:
    """One row: how many TypeScript source files there are."""
    return files.where(F.col("path").rlike(r"\.tsx?$")).agg(F.count(F.lit(1)).alias("source_files"))
