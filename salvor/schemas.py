"""Record schemas, value domains and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The allowed words of each coded field.
AVAILABILITY = ["healthy", "unavailable", "unknown"]
ARTIFACT_TYPES = ["dataset", "feature", "model", "dashboard"]
RISK_LEVELS = ["low", "medium", "high"]
RISK_MODES = ["conservative", "demo"]
DECISIONS = ["recovery_target", "healthy_precondition", "excluded"]
RUN_STATUS = ["planned", "approved", "running", "failed", "completed"]
STEP_STATUS = ["pending", "running", "failed", "verified"]
DEPTH_RANGE = (0, 25)
DEFAULT_DEPTH = 10

VALIDATION = "struct<kind:string,parameters:map<string,string>,parameters_json:string,required:boolean>"
EVIDENCE = "struct<source:string,tool:string,upstream_urn:string,downstream_urn:string>"

ASSETS = (
    "urn string, display_name string, artifact_type string, platform string, domain string, "
    "tags array<string>, availability string, owner string, adapter string, "
    "adapter_parameters map<string,string>, parameters_json string, "
    f"validations array<{VALIDATION}>, risk string, requires_approval boolean"
)
EDGES = f"upstream_urn string, downstream_urn string, evidence {EVIDENCE}"
REQUESTS = (
    "request_id string, incident_type string, unavailable_asset_urns array<string>, "
    "target_recovery_point timestamp, max_blast_radius_depth int, risk_mode string, requester string"
)
LEDGER = (
    "run_id string, step_id string, target_urn string, seq bigint, status string, "
    "at timestamp, error_type string, error_detail string, action string"
)
RECEIPTS = (
    "run_id string, operation string, project string, verified boolean, fingerprint string, "
    "recorded_at timestamp, body string"
)


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Fill defaults and make the seed list sorted and distinct."""
    return requests.select(
        "request_id",
        "incident_type",
        F.array_sort(F.array_distinct("unavailable_asset_urns")).alias("unavailable_asset_urns"),
        "target_recovery_point",
        F.coalesce("max_blast_radius_depth", F.lit(DEFAULT_DEPTH)).alias("max_blast_radius_depth"),
        F.coalesce("risk_mode", F.lit(RISK_MODES[0])).alias("risk_mode"),
        "requester",
    )


def _blank(name: str) -> Column:
    return F.coalesce(F.length(name), F.lit(0)) < 1


def _outside(name: str, words: list[str]) -> Column:
    return ~F.coalesce(F.col(name).isin(words), F.lit(False))


def _rejects(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows that break a rule, with the names of all broken rules."""
    broken = F.filter(
        F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]), lambda x: x.isNotNull()
    )
    return df.withColumn("broken_rules", broken).filter(F.size("broken_rules") > 0)


def rejected_assets(assets: DataFrame) -> DataFrame:
    return _rejects(
        assets,
        [
            ("urn is empty", _blank("urn")),
            ("display_name is empty", _blank("display_name")),
            ("platform is empty", _blank("platform")),
            ("domain is empty", _blank("domain")),
            ("artifact_type is not allowed", _outside("artifact_type", ARTIFACT_TYPES)),
            ("availability is not allowed", _outside("availability", AVAILABILITY)),
            ("risk is not allowed", _outside("risk", RISK_LEVELS)),
            (
                "validation kind is empty",
                F.exists("validations", lambda v: F.coalesce(F.length(v["kind"]), F.lit(0)) < 1),
            ),
        ],
    )


def rejected_edges(edges: DataFrame) -> DataFrame:
    return _rejects(
        edges,
        [
            ("upstream_urn is missing", F.col("upstream_urn").isNull()),
            ("downstream_urn is missing", F.col("downstream_urn").isNull()),
            (
                "evidence upstream_urn differs from the edge",
                (F.length("upstream_urn") > 0)
                & ~F.col("evidence.upstream_urn").eqNullSafe(F.col("upstream_urn")),
            ),
            (
                "evidence downstream_urn differs from the edge",
                (F.length("downstream_urn") > 0)
                & ~F.col("evidence.downstream_urn").eqNullSafe(F.col("downstream_urn")),
            ),
        ],
    )


def rejected_requests(requests: DataFrame) -> DataFrame:
    return _rejects(
        requests,
        [
            ("request_id is empty", _blank("request_id")),
            ("incident_type is empty", _blank("incident_type")),
            ("requester is empty", _blank("requester")),
            ("no unavailable asset", F.coalesce(F.size("unavailable_asset_urns"), F.lit(0)) < 1),
            (
                "max_blast_radius_depth is out of range",
                ~F.coalesce(F.col("max_blast_radius_depth").between(*DEPTH_RANGE), F.lit(False)),
            ),
            ("risk_mode is not allowed", _outside("risk_mode", RISK_MODES)),
        ],
    )


def duplicate_urns(assets: DataFrame) -> DataFrame:
    return (
        assets.groupBy("urn").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    )


def step_for_urn(plan_steps: DataFrame, urn: str) -> DataFrame:
    return plan_steps.filter(F.col("target_urn") == urn)
