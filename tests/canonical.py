"""Digests over a whole table or catalog as one JSON document: the form the identifiers
were first defined in. It gathers everything in one row, so it is for fixtures only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salvor.functions.text import canonical_json, json_array, json_number, json_object, json_string
from salvor.plans.identity import asset_json, edge_json


def canonical_table_digest(df: DataFrame) -> DataFrame:
    """SHA-256 over the table as one JSON document (sorted rows, UTF-8, final newline)."""
    values = {}
    for field in df.schema.fields:
        col = F.col(f"r.{field.name}")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            values[field.name] = json_number(col)
        elif isinstance(field.dataType, T.StringType):
            values[field.name] = json_string(col)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            stamp = col.cast("timestamp")
            micros = F.date_format(stamp, ".SSSSSS")
            values[field.name] = F.concat(
                F.lit('"'),
                F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"),
                F.when(micros != ".000000", micros).otherwise(""),
                F.lit('+00:00"'),
            )
        else:
            values[field.name] = F.coalesce(col.cast("string"), F.lit("null"))
    ordered = F.struct(
        *[
            part
            for i, c in enumerate(df.columns)
            for part in (F.col(c).isNull().alias(f"_n{i}"), F.col(c).alias(c))
        ]
    )
    rows = df.select(ordered.alias("r")).select("r", json_object(values).alias("j"))
    rows = rows.select("r", canonical_json(F.col("j"), False).alias("j"))
    whole = rows.agg(F.sort_array(F.collect_list(F.struct("r", "j"))).alias("rows"))
    schema = ",".join(f'"{c}"' for c in df.columns)
    body = F.concat(
        F.lit('{"rows":'),
        json_array(F.transform("rows", lambda x: x["j"])),
        F.lit(f',"schema":[{schema}]}}\n'),
    )
    return whole.select(
        F.size("rows").cast("bigint").alias("row_count"), F.sha2(body, 256).alias("digest")
    )


def canonical_graph_digest(assets: DataFrame, edges: DataFrame, source_instance: str) -> DataFrame:
    """SHA-256 over the whole catalog as one JSON document."""
    a = assets.select("urn", asset_json().alias("j")).select("urn", canonical_json(F.col("j"), True).alias("j"))
    a = a.agg(F.sort_array(F.collect_list(F.struct("urn", "j"))).alias("a"))
    pairs = ["upstream_urn", "downstream_urn"]
    e = edges.select(*pairs, edge_json().alias("j")).select(*pairs, canonical_json(F.col("j"), True).alias("j"))
    e = e.agg(F.sort_array(F.collect_list(F.struct(*pairs, "j"))).alias("e"))
    body = json_object(
        {
            "assets": json_array(F.transform("a", lambda r: r["j"])),
            "edges": json_array(F.transform("e", lambda r: r["j"])),
            "source_instance": canonical_json(json_string(F.lit(source_instance)), True),
        }
    )
    # One row on either side.
    return a.join(F.broadcast(e), F.lit(True)).select(F.sha2(body, 256).alias("fingerprint"))
