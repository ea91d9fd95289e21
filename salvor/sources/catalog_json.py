"""Catalog snapshots as nested JSON documents, or as lines of assets and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

_VALIDATION = "struct<kind:string,parameters:variant,required:boolean>"
_ASSET = (
    "struct<urn:string,display_name:string,artifact_type:string,platform:string,domain:string,"
    "tags:array<string>,availability:string,owner:string,adapter:string,"
    f"adapter_parameters:variant,validations:array<{_VALIDATION}>,risk:string,"
    "requires_approval:boolean>"
)
_EDGE = (
    "struct<upstream_urn:string,downstream_urn:string,"
    "evidence:struct<source:string,tool:string,upstream_urn:string,downstream_urn:string>>"
)
SNAPSHOT = f"source_instance string, captured_at timestamp, assets array<{_ASSET}>, edges array<{_EDGE}>"

# The field names a snapshot may use at each level.
SNAPSHOT_KEYS = ["source_instance", "captured_at", "assets", "edges"]
ASSET_KEYS = [
    "urn", "display_name", "artifact_type", "platform", "domain", "tags", "availability", "owner",
    "adapter", "adapter_parameters", "validations", "risk", "requires_approval",
]
EDGE_KEYS = ["upstream_urn", "downstream_urn", "evidence"]


# Lines of a packed file of edges, about 400 MB before packing.
FILE_ROWS = 1_000_000


def _text(value):
    return F.coalesce(F.to_json(value), F.lit("{}"))


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read snapshot documents; returns (snapshots, assets, edges).

    Every document is one JSON object, possibly over many lines. A document that
    does not fit the schema fails the read. ``snapshot_id`` is the file path.
    """
    docs = (
        spark.read.schema(SNAPSHOT)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path)
        .withColumn("snapshot_id", F.col("_metadata.file_path"))
    )
    snapshots = docs.select("snapshot_id", "source_instance", "captured_at")
    assets = _assets(docs.select("snapshot_id", F.explode("assets").alias("a")), "snapshot_id")
    edges = _edges(docs.select("snapshot_id", F.explode("edges").alias("e")), "snapshot_id")
    return snapshots, assets, edges


def _assets(a: DataFrame, *keys: str) -> DataFrame:
    return a.select(
        *keys, "a.urn", "a.display_name", "a.artifact_type", "a.platform", "a.domain",
        "a.tags", F.coalesce("a.availability", F.lit("unknown")).alias("availability"),
        "a.owner", "a.adapter",
        F.from_json(_text(F.col("a.adapter_parameters")), "map<string,string>").alias("adapter_parameters"),
        _text(F.col("a.adapter_parameters")).alias("parameters_json"),
        F.transform(
            F.coalesce("a.validations", F.array().cast(f"array<{_VALIDATION}>")),
            lambda v: F.struct(
                v["kind"].alias("kind"),
                F.from_json(_text(v["parameters"]), "map<string,string>").alias("parameters"),
                _text(v["parameters"]).alias("parameters_json"),
                F.coalesce(v["required"], F.lit(True)).alias("required"),
            ),
        ).alias("validations"),
        F.coalesce("a.risk", F.lit("low")).alias("risk"),
        F.coalesce("a.requires_approval", F.lit(False)).alias("requires_approval"),
    )


def _edges(e: DataFrame, *keys: str) -> DataFrame:
    return e.select(
        *keys, "e.upstream_urn", "e.downstream_urn",
        F.struct(
            F.coalesce("e.evidence.source", F.lit("datahub_mcp")).alias("source"),
            F.coalesce("e.evidence.tool", F.lit("get_lineage")).alias("tool"),
            F.col("e.evidence.upstream_urn").alias("upstream_urn"),
            F.col("e.evidence.downstream_urn").alias("downstream_urn"),
        ).alias("evidence"),
    )


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(DataType.fromDDL(schema)).option("mode", "FAILFAST").json(path)


def read_asset_rows(spark: SparkSession, path: str) -> DataFrame:
    """Assets stored as one JSON object per line; files of any size are read in splits."""
    rows = _lines(spark, path, _ASSET)
    return _assets(rows.select(F.struct(*rows.columns).alias("a")))


def read_edge_rows(spark: SparkSession, path: str) -> DataFrame:
    """Edges stored as one JSON object per line, packed or plain."""
    rows = _lines(spark, path, _EDGE)
    return _edges(rows.select(F.struct(*rows.columns).alias("e")))


def write_edge_rows(edges: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Edges as packed lines, since every line names both ends twice.

    A packed file is read by one task, so none has more than ``file_rows`` lines.
    """
    lines = edges.select("upstream_urn", "downstream_urn", "evidence").write.mode("append")
    lines.option("compression", "gzip").option("maxRecordsPerFile", file_rows).json(path)


def extra_keys(spark: SparkSession, path: str) -> DataFrame:
    """Unknown field names in snapshot documents, by level; empty when strict."""
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("snapshot_id"), "value"
    )
    top = docs.select("snapshot_id", F.lit("snapshot").alias("level"), F.explode(F.json_object_keys("value")).alias("key"))

    def inner(field: str) -> DataFrame:
        items = F.from_json(F.get_json_object("value", f"$.{field}"), "array<string>")
        one = docs.select("snapshot_id", F.explode(items).alias("item"))
        return one.select(
            "snapshot_id", F.lit(field).alias("level"), F.explode(F.json_object_keys("item")).alias("key")
        ).distinct()

    allowed = (
        (F.col("level") == "snapshot") & F.col("key").isin(SNAPSHOT_KEYS)
        | (F.col("level") == "assets") & F.col("key").isin(ASSET_KEYS)
        | (F.col("level") == "edges") & F.col("key").isin(EDGE_KEYS)
    )
    return top.unionByName(inner("assets")).unionByName(inner("edges")).filter(~allowed)
