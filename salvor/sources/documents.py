"""JSON artifacts, receipts and file facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salvor.schemas import RECEIPTS


def is_json_object(text: Column) -> Column:
    return F.coalesce(
        F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False)
    )


def object_keys(text: Column) -> Column:
    """Sorted top-level keys of a JSON object, null for anything else."""
    return F.when(is_json_object(text), F.array_sort(F.json_object_keys(text)))


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """One row per artifact file: path, text, change time, byte digest, is it an object."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    return files.select(
        "path",
        F.col("modificationTime").alias("modified_at"),
        F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"),
        text.alias("document"),
        is_json_object(text).alias("is_object"),
    )


def artifact_payload(artifacts: DataFrame, path_suffix: str, schema: str) -> DataFrame:
    one = artifacts.filter(F.col("path").endswith(path_suffix) & F.col("is_object"))
    return one.select(F.from_json("document", schema).alias("payload")).select("payload.*")


def newest_change(spark: SparkSession, path: str) -> DataFrame:
    """The latest file change time below a Parquet path, from the list of its files.

    One row per file; contents are not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.max("modificationTime").alias("modified_at"))


def read_receipts(spark: SparkSession, path: str, schema: str = RECEIPTS) -> DataFrame:
    """Receipt lines; a line that does not fit the schema gets ``readable = false``."""
    lines = (
        spark.read.schema(schema + ", _bad string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
    )
    return lines.withColumn("readable", F.col("_bad").isNull())
