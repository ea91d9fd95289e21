"""Canonical documents and the identifiers derived from them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salvor.functions.digests import lane_state, moved_state, sha_prefix, state_digest
from salvor.functions.text import canonical_json, json_array, json_bool, json_object, json_string

# Fixed value: part of every plan identifier.
COMPILER_VERSION = "0.1.0"


def validations_json(validations: Column) -> Column:
    return json_array(
        F.transform(
            F.coalesce(validations, F.array()),
            lambda v: json_object(
                {
                    "kind": json_string(v["kind"]),
                    "parameters": F.coalesce(v["parameters_json"], F.lit("{}")),
                    "required": json_bool(F.coalesce(v["required"], F.lit(True))),
                }
            ),
        )
    )


def asset_json() -> Column:
    text = {
        name: json_string(F.col(name))
        for name in ("urn", "display_name", "artifact_type", "platform", "domain", "owner", "adapter")
    }
    return json_object(
        text
        | {
            "adapter_parameters": F.coalesce("parameters_json", F.lit("{}")),
            "availability": json_string(F.coalesce("availability", F.lit("unknown"))),
            "requires_approval": json_bool(F.coalesce("requires_approval", F.lit(False))),
            "risk": json_string(F.coalesce("risk", F.lit("low"))),
            "tags": json_array(F.transform("tags", lambda t: json_string(t))),
            "validations": validations_json(F.col("validations")),
        }
    )


def edge_json() -> Column:
    fields = ("source", "tool", "upstream_urn", "downstream_urn")
    return json_object(
        {
            "upstream_urn": json_string(F.col("upstream_urn")),
            "downstream_urn": json_string(F.col("downstream_urn")),
            "evidence": json_object({f: json_string(F.col(f"evidence.{f}")) for f in fields}),
        }
    )


ASSET_KINDS = {"urn": "text", "document": "text"}
EDGE_KINDS = {c: "text" for c in ("upstream_urn", "downstream_urn", "source", "tool")}


def _asset_rows(assets: DataFrame) -> DataFrame:
    return assets.select(F.col("urn"), asset_json().alias("document"))


def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select("upstream_urn", "downstream_urn", "evidence.source", "evidence.tool")


class GraphState(NamedTuple):
    """Row counts and lane sums of a catalog's assets and of its edges, a row each."""

    assets: DataFrame
    edges: DataFrame


def graph_state(assets: DataFrame, edges: DataFrame) -> GraphState:
    return GraphState(lane_state(_asset_rows(assets), ASSET_KINDS), lane_state(_edge_rows(edges), EDGE_KINDS))


def moved_graph(
    state: GraphState, added_assets: DataFrame, removed_assets: DataFrame, added_edges: DataFrame, removed_edges: DataFrame
) -> GraphState:
    """The state after a difference of catalogs; only the difference is read and hashed.

    A changed asset is removed as it was and added as it is.
    """
    return GraphState(
        moved_state(state.assets, _asset_rows(added_assets), _asset_rows(removed_assets), ASSET_KINDS),
        moved_state(state.edges, _edge_rows(added_edges), _edge_rows(removed_edges), EDGE_KINDS),
    )


def graph_state_digest(state: GraphState, source_instance: str) -> DataFrame:
    """The catalog digest of a state; null where rows were removed that never were there."""
    parts = state_digest(state.assets, list(ASSET_KINDS)).select(F.lit("assets").alias("part"), "digest").unionByName(
        state_digest(state.edges, list(EDGE_KINDS)).select(F.lit("edges").alias("part"), "digest")
    )
    of_assets, of_edges = (F.max(F.when(F.col("part") == part, F.col("digest"))) for part in ("assets", "edges"))
    both = F.sha2(F.concat_ws("|", F.lit(source_instance), of_assets, of_edges), 256)
    return parts.agg(F.when(of_assets.isNotNull() & of_edges.isNotNull(), both).alias("fingerprint"))


def graph_digest(assets: DataFrame, edges: DataFrame, source_instance: str) -> DataFrame:
    """Order-free catalog digest: one aggregation over assets and one over edges."""
    return graph_state_digest(graph_state(assets, edges), source_instance)


def request_json() -> Column:
    point = F.col("target_recovery_point")
    micros = F.date_format(point, ".SSSSSS")
    point_text = F.when(point.isNull(), F.lit("null")).otherwise(
        F.concat(
            F.lit('"'),
            F.date_format(point, "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(micros != ".000000", micros).otherwise(""),
            F.lit('Z"'),
        )
    )
    return json_object(
        {
            "request_id": json_string(F.col("request_id")),
            "incident_type": json_string(F.col("incident_type")),
            "max_blast_radius_depth": F.col("max_blast_radius_depth").cast("string"),
            "requester": json_string(F.col("requester")),
            "risk_mode": json_string(F.col("risk_mode")),
            "target_recovery_point": point_text,
            "unavailable_asset_urns": json_array(
                F.transform("unavailable_asset_urns", lambda u: json_string(u))
            ),
        }
    )


def with_plan_id(requests: DataFrame, fingerprint: Column) -> DataFrame:
    document = json_object(
        {
            "compiler_version": json_string(F.lit(COMPILER_VERSION)),
            "graph_fingerprint": json_string(fingerprint),
            "request": request_json(),
        }
    )
    written = requests.withColumn("_document", document)
    key = sha_prefix(canonical_json(F.col("_document"), True), 20)
    return written.withColumn("plan_id", F.concat(F.lit("plan-"), key)).drop("_document")


def step_id(plan: Column, urn: Column) -> Column:
    return F.concat(F.lit("step-"), sha_prefix(F.concat_ws(":", plan, urn), 16))


def idempotency_key(plan: Column, step: Column) -> Column:
    return F.concat_ws(":", plan, step)
