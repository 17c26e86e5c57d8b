"""JSON record batches, as indexers deliver them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of the batches.
BATCHES = {
    "operations": "project string, symbol string, gqlName string, kind string, file string, line bigint, exported boolean",
    "hooks": "project string, name string, file string, line bigint, operations array<string>",
    "callsites": "project string, target string, targetKind string, file string, line bigint, column bigint",
    "routes": "project string, path string, index boolean, depth bigint, parentPath string, file string, line bigint, components array<string>, guards array<string>, permissions array<string>",
    "components": "project string, name string, file string, line bigint, exported boolean, hookCalls array<string>, operationRefs array<string>",
    "permissions": "project string, key string, roles array<string>, file string, line bigint",
    "pages": "project string, domain string, entity string, dir string, components array<struct<name:string,file:string>>, by_role map<string,string>, subdirs array<string>",
    "docs": "project string, name string, file string, title string, size bigint, headings array<struct<level:int,text:string>>",
    "specs": "project string, name string, file string, line bigint, kind string, poms array<string>",
    "page_objects": "project string, name string, file string",
    "locators": "project string, module string, name string, value string, parametric boolean, testids array<string>, file string, line bigint",
    "testids": "project string, value string, file string, line bigint, pattern boolean, template string",
    "scss": "project string, file string, classes array<string>",
    "scss_imports": "project string, consumer string, module_file string",
    "projects": "name string, root string",
}

#: Columns that a batch may have besides: a call site may tell the file that declares its target.
OPTIONAL = {"callsites": ", targetFile string"}


def read_batch(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of one kind, with their stated schema: nothing is inferred, unknown fields are left out.

    What is no record, or has a field of another type, is left out too; ``rejected_records`` tells what that was.
    """
    return _read(spark, path, kind).where("_corrupt is null").drop("_corrupt", "file_of_record")


def rejected_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(kind, file, record, reason) of the lines that ``read_batch`` leaves out."""
    rows = _read(spark, path, kind).where("_corrupt is not null").select(F.lit(kind).alias("kind"), "file_of_record", F.col("_corrupt").alias("record"))
    reason = F.when(F.try_parse_json("record").isNull(), "no JSON").otherwise("a field of another type")
    return rows.withColumnRenamed("file_of_record", "file").withColumn("reason", reason)


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Every line that is not blank, its record's fields, and the line itself where it is no record."""
    schema = T._parse_datatype_string(BATCHES[kind] + OPTIONAL.get(kind, "")).add("_corrupt", "string")
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file_of_record"))
    return lines.select("file_of_record", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("file_of_record", "r.*")


def empty_batches(spark: SparkSession) -> dict[str, DataFrame]:
    return {k: spark.createDataFrame([], s) for k, s in BATCHES.items()}
